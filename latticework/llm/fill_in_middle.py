"""Fill-in-middle: texts cut in three, arranged behind sentinels, and put together again.

Native functions only: `regexp_extract_all` makes the array of units, `conv` and
`substring` of `sha2` the cuts, `slice` and `array_join` the parts, `split_part` at
the sentinels restores the text. One projection over one scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
#: A unit is what this matches; units must cover a text from end to end.
CODE_POINT = "(?s)."


def checked(sentinels: Sequence[str]) -> None:
    """Refuse sentinels that could be seen across a border of text and sentinel: parsing must find no others."""
    if len(sentinels) != 3 or not all(sentinels):
        raise ValueError("three sentinels are needed, none empty")
    for a in sentinels:
        for b in sentinels:
            if a is not b and a in b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")


def drawn(row_id: Column, seed: str, k: int) -> Column:
    """The k-th group of 8 hex digits, from 0, of a hash of the seed and the id, as a number below 2**32."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def arrange(docs: DataFrame, text: str = "text", row_id: str = "doc_id", seed: str = "1", unit: str = CODE_POINT, sentinels: Sequence[str] = SENTINELS, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per input row.

    A text of n units is cut at two places drawn from its id: prefix, middle and
    suffix. Of all ids, `percent` in a hundred are arranged, and of those
    `spm_percent` in a hundred as suffix, prefix, middle (form spm), the others as
    prefix, suffix, middle (psm), each part behind its sentinel. Lengths are in code
    points. All else is plain: the text as it is, lengths null. So are empty texts,
    texts that hold a sentinel and texts that are not valid UTF-8.

    A null text counts as empty, a null id as empty text in the hash. Repeated rows
    give repeated results; equal texts of different ids are cut apart. A text of any
    length is one array of its units, held by one task. No rows give no rows. Further
    columns are ignored, whatever their names.
    """
    checked(sentinels)
    prefix, suffix, middle = (F.lit(s) for s in sentinels)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(row_id).alias("doc_id"), body.alias("text"), *[drawn(F.col(row_id), seed, k).alias(f"h{k + 1}") for k in range(4)])
    holds = F.contains("text", prefix) | F.contains("text", suffix) | F.contains("text", middle)
    plain = (F.col("text") == "") | holds | (F.col("h3") % 100 >= percent) | ~F.is_valid_utf8("text")
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit(unit), F.lit(0))).withColumn("n", F.size("units").cast("long"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.withColumn("low", F.least(a, b).cast("int")).withColumn("high", F.greatest(a, b).cast("int"))

    def part(start: Column, stop: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start + 1, stop - start), ""))

    parts = rows.select("doc_id", "text", "n", "form", part(F.lit(0), F.col("low")).alias("p"), part(F.col("low"), F.col("high")).alias("m"), part(F.col("high"), F.size("units")).alias("s"))
    psm = F.concat(prefix, "p", suffix, "s", middle, "m")
    spm = F.concat(suffix, "s", prefix, "p", middle, "m")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return parts.select("doc_id", "n", "form", F.char_length("p").cast("long").alias("prefix_chars"), F.char_length("m").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: str | Column, form: str | Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text of an arranged output: parts are read between its sentinels. Null if one of the two is null."""
    checked(sentinels)
    prefix, suffix, middle = (F.lit(s) for s in sentinels)
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def after(mark: Column, until: Column | None = None) -> Column:
        rest = F.split_part(output, mark, F.lit(2))
        return rest if until is None else F.split_part(rest, until, F.lit(1))

    psm = F.concat(after(prefix, suffix), after(middle), after(suffix, middle))
    spm = F.concat(after(prefix, middle), after(middle), after(suffix, prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).when(form.isNotNull(), output)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, a, b, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
