"""Table layouts, as DDL, shared by sources, plans and sinks."""

from __future__ import annotations

GAP = "-"

# One row per alignment record; the unexploded form every plan starts from.
RECORDS = "gene STRING, species STRING, seq STRING"

# One row per symbol of a record.
CELLS = "gene STRING, species STRING, pos INT, symbol STRING"

# Group definitions: grp 1 is the foreground, grp 0 the background.
GROUPS = "trait STRING, species STRING, grp INT"

CYCLES = "cycle STRING, fg ARRAY<STRING>, bg ARRAY<STRING>"

FAMILIES = "species STRING, family STRING"

TRAIT_VALUES = "species STRING, value DOUBLE, label INT"

DISCOVERY = (
    "Gene STRING, Trait STRING, Position INT, Substitution STRING, Pvalue DOUBLE, "
    "Pattern STRING, FFGN INT, FBGN INT, GFG INT, GBG INT, MFG INT, MBG INT, "
    "FFG STRING, FBG STRING, MS STRING"
)

BOOTSTRAP = (
    "position STRING, count INT, cycles INT, empval DOUBLE, cycle_list STRING, "
    "trait_config STRING"
)

TREE_EDGES = (
    "tree STRING, node BIGINT, parent BIGINT, label STRING, "
    "parent_label STRING, length DOUBLE, is_tip BOOLEAN"
)
