"""Training-data operators: dedup, packing, media, scoring, filtering, mixing.

Each module holds one operator with a general interface; `queries` registers
the thin `opN_<name>` queries over the driver's tables.
"""
