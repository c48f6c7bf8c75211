"""DuckDB statements that answer the catalog's queries the long way."""

from __future__ import annotations

# Fixed settings shared with catalog.py: seed, cycles, thresholds.
_LINE_CELLS = """
line_raw AS (
  SELECT 'g' || l_suppkey AS gene,
         'sp' || lpad(CAST(l_partkey % 100 AS VARCHAR), 3, '0') AS species,
         l_linenumber - 1 AS pos,
         CASE WHEN floor(l_quantity) % 10 = 9 THEN '-'
              ELSE chr(65 + CAST(floor(l_quantity) % 4 AS INT)) END AS symbol
  FROM lineitem
),
members_of AS (SELECT DISTINCT gene, species FROM line_raw),
filled AS (SELECT gene, species, pos, max(symbol) AS symbol FROM line_raw GROUP BY ALL),
cells AS (
  SELECT m.gene, m.species, CAST(p.pos AS INT) AS pos, coalesce(f.symbol, '-') AS symbol
  FROM members_of m CROSS JOIN (SELECT unnest(range(7)) AS pos) p
  LEFT JOIN filled f ON f.gene = m.gene AND f.species = m.species AND f.pos = p.pos
)"""

_DOCUMENT_CELLS = """
members_of AS (SELECT source AS gene, 'd' || doc_id AS species FROM documents),
cells AS (
  SELECT source AS gene, 'd' || doc_id AS species,
         CAST(unnest(range(length(text))) AS INT) AS pos,
         unnest(string_split(text, '')) AS symbol
  FROM documents
)"""

_SIZE_GROUPS = """
sizes_by_species AS (
  SELECT 'sp' || lpad(CAST(p_partkey % 100 AS VARCHAR), 3, '0') AS species, sum(p_size) AS size
  FROM part GROUP BY 1
),
size_groups AS (
  SELECT * FROM (SELECT 'size' AS trait, species, 1 AS grp FROM sizes_by_species
                 ORDER BY size DESC, species LIMIT 4)
  UNION ALL
  SELECT * FROM (SELECT 'size' AS trait, species, 0 AS grp FROM sizes_by_species
                 ORDER BY size, species LIMIT 3)
)"""

_NATION_GROUPS = """
nation_groups AS (
  SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS trait,
         'sp' || lpad(CAST((n_nationkey * 4 + j) % 100 AS VARCHAR), 3, '0') AS species,
         CASE WHEN j < 4 THEN 1 ELSE 0 END AS grp
  FROM nation, (SELECT unnest(range(7)) AS j)
)"""

_LABEL_GROUPS = """
label_groups AS (
  SELECT 'quality_' || source AS trait, 'd' || doc_id AS species, quality AS grp
  FROM labels JOIN documents USING (doc_id)
  UNION ALL
  SELECT 'toxic_' || source, 'd' || doc_id, toxic FROM labels JOIN documents USING (doc_id)
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n"


_PROFILE = """
heights AS (SELECT gene, count(*) AS total FROM members_of GROUP BY gene),
hist AS (SELECT gene, pos, symbol, count(*) AS n FROM cells GROUP BY ALL),
solid_hist AS (SELECT * FROM hist WHERE symbol <> '-'),
profile AS (
  SELECT gene, pos, any_value(total) AS total,
         any_value(total) - coalesce(sum(n) FILTER (symbol <> '-'), 0) AS gaps,
         coalesce(sum(n) FILTER (symbol <> '-'), 0) AS nongap,
         count(*) FILTER (symbol <> '-') AS n_symbols,
         coalesce(max(n) FILTER (symbol <> '-'), 0) AS top,
         coalesce(sum(n) FILTER (symbol <> '-'), 0) - coalesce(max(n) FILTER (symbol <> '-'), 0) AS minority
  FROM hist JOIN heights USING (gene) GROUP BY gene, pos
)"""

_DRAWN = "list_reduce(range({n})::DOUBLE[], lambda p, i: p * ({w} - i) / ({m} - i), 1.0::DOUBLE)"


def _all_drawn(deck: str, drawn: str, wanted: str) -> str:
    body = _DRAWN.format(n=drawn, w=f"({wanted})", m=f"({deck})")
    return (
        f"CASE WHEN {drawn} = 0 THEN 1.0 WHEN ({wanted}) < {drawn} OR ({wanted}) > ({deck}) "
        f"THEN 0.0 ELSE {body} END"
    )


def _pvalue(source: str, f: str, b: str, key: str) -> str:
    """P-value per key from rows (key, f, b, n) with one row per symbol."""
    return f"""
pv_terms AS (
  SELECT {key}, {f} AS f, {b} AS b, n, CAST(sum(n) OVER (PARTITION BY {key}) AS BIGINT) AS m
  FROM {source}
),
pv_factors AS (
  SELECT {key}, f, b,
         {_all_drawn("m", "f", "n")} AS f1, {_all_drawn("m - f", "b", "n")} AS b1,
         {_all_drawn("m", "f", "m - n")} AS fr, {_all_drawn("m - f", "b", "m - n")} AS br
  FROM pv_terms
),
pvalues AS (
  SELECT {key},
         round(CASE WHEN any_value(f) = any_value(b) THEN sum(f1 * br)
              WHEN count(*) = 2 THEN sum(f1 * br) + sum(fr * b1)
              ELSE sum(f1 * br) + sum(fr * b1) - (sum(f1) * sum(b1) - sum(f1 * b1)) END, 9) AS pvalue
  FROM pv_factors GROUP BY {key}
)"""


def _evidence(groups: str) -> str:
    return f"""
met AS (
  SELECT c.gene, c.pos, g.trait, g.grp, c.species, c.symbol
  FROM cells c JOIN {groups} g ON c.species = g.species
),
evidence AS (
  SELECT gene, pos, trait,
         list_sort(array_agg(DISTINCT symbol) FILTER (grp = 1 AND symbol <> '-')) AS fgs,
         list_sort(array_agg(DISTINCT symbol) FILTER (grp = 0 AND symbol <> '-')) AS bgs,
         count(*) FILTER (grp = 1 AND symbol <> '-') AS ffgn,
         count(*) FILTER (grp = 0 AND symbol <> '-') AS fbgn,
         list_sort(array_agg(species) FILTER (grp = 1 AND symbol <> '-')) AS ffg,
         list_sort(array_agg(species) FILTER (grp = 0 AND symbol <> '-')) AS fbg
  FROM met GROUP BY gene, pos, trait
  HAVING ffgn > 0 AND fbgn > 0
),
present AS (
  SELECT m.gene, g.trait,
         count(*) FILTER (grp = 1) AS pfg, count(*) FILTER (grp = 0) AS pbg,
         array_agg(m.species) AS names
  FROM members_of m JOIN {groups} g ON m.species = g.species GROUP BY 1, 2
),
wanted AS (
  SELECT trait, count(*) FILTER (grp = 1) AS n_fg, count(*) FILTER (grp = 0) AS n_bg,
         array_agg(species) AS names
  FROM {groups} GROUP BY 1
),
lacking AS (
  SELECT p.gene, p.trait, n_fg - pfg AS mfg, n_bg - pbg AS mbg, pfg, pbg, n_fg, n_bg,
         array_to_string(list_sort(list_filter(w.names, lambda x: NOT list_contains(p.names, x))), ',') AS missing
  FROM present p JOIN wanted w USING (trait)
),
judged AS (
  SELECT e.*, pfg - ffgn AS gfg, pbg - fbgn AS gbg, mfg, mbg, missing, n_fg, n_bg,
         NOT list_has_any(fgs, bgs) AS is_hit,
         CASE WHEN len(fgs) = 1 AND len(bgs) = 1 THEN 1 WHEN len(fgs) = 1 THEN 2
              WHEN len(bgs) = 1 THEN 3 ELSE 4 END AS pattern
  FROM evidence e JOIN lacking USING (gene, trait)
)"""


_DISCOVERY_COLUMNS = """
SELECT gene AS "Gene", trait AS "Trait", pos AS "Position",
       array_to_string(fgs, '') || '/' || array_to_string(bgs, '') AS "Substitution",
       pvalue AS "Pvalue", 'pattern' || pattern AS "Pattern",
       CAST(ffgn AS INT) AS "FFGN", CAST(fbgn AS INT) AS "FBGN",
       CAST(gfg AS INT) AS "GFG", CAST(gbg AS INT) AS "GBG",
       CAST(mfg AS INT) AS "MFG", CAST(mbg AS INT) AS "MBG",
       array_to_string(ffg, ',') AS "FFG", array_to_string(fbg, ',') AS "FBG",
       CASE WHEN missing = '' THEN '-' ELSE missing END AS "MS"
FROM hits JOIN pvalues USING (gene, pos, trait)"""


def _hits(patterns: str, ratio: str, threshold: str, bounds: str) -> str:
    return f"""
hits AS (
  SELECT j.* FROM judged j JOIN profile p USING (gene, pos)
  WHERE is_hit AND pattern IN ({patterns}) AND gaps / total <= {ratio}
    AND minority >= {threshold} AND {bounds}
),
hit_counts AS (
  SELECT h.gene, h.pos, h.trait, h.ffgn, h.fbgn, s.n FROM hits h JOIN solid_hist s USING (gene, pos)
)"""


def _discovery(
    cells: str,
    groups_cte: str,
    groups: str,
    patterns: str = "1, 2, 3",
    ratio: str = "0.5",
    threshold: str = "least(n_fg, n_bg)",
    bounds: str = "true",
) -> str:
    return (
        _with(
            cells,
            groups_cte,
            _PROFILE,
            _evidence(groups),
            _hits(patterns, ratio, threshold, bounds),
            _pvalue("hit_counts", "ffgn", "fbgn", "gene, pos, trait"),
        )
        + _DISCOVERY_COLUMNS
    )


_BATCH = _discovery(_LINE_CELLS, _NATION_GROUPS, "nation_groups")


def _hash60(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


def _sample(pool: str, quotas: str, cycles: int, seed: int = 7, prefix: str = "") -> str:
    """Groups per cycle from a pool (stratum, species) and quotas (stratum, n_fg, n_bg)."""
    draw = _hash60(f"'{seed}'", "cycle_no", "stratum", "j") + " % (j + 1)"
    return f"""
{prefix}numbered AS (
  SELECT stratum, species,
         row_number() OVER (PARTITION BY stratum ORDER BY md5(species), species) - 1 AS idx,
         count(*) OVER (PARTITION BY stratum) AS size
  FROM (SELECT DISTINCT stratum, species FROM {pool})
),
{prefix}tasks AS (
  SELECT cycle_no, q.stratum, n_fg, n_fg + n_bg AS m, s.size
  FROM {quotas} q JOIN (SELECT DISTINCT stratum, size FROM {prefix}numbered) s USING (stratum),
       (SELECT unnest(range(1, {cycles} + 1)) AS cycle_no)
  WHERE n_fg + n_bg > 0
),
{prefix}picked AS (
  SELECT cycle_no, stratum, n_fg,
         unnest(list_reduce(range(size - m, size)::BIGINT[],
           lambda chosen, j: list_append(chosen, CASE WHEN list_contains(chosen, {draw}) THEN j ELSE {draw} END),
           []::BIGINT[])) AS idx
  FROM {prefix}tasks
),
{prefix}placed AS (
  SELECT cycle_no, stratum, n_fg, idx,
         row_number() OVER (PARTITION BY cycle_no, stratum
           ORDER BY md5(concat_ws('|', '{seed}', cycle_no, stratum, 'order', idx))) AS nth
  FROM {prefix}picked
),
{prefix}drawn AS (
  SELECT 'b_' || cycle_no AS trait, cycle_no, species, CASE WHEN nth <= n_fg THEN 1 ELSE 0 END AS grp
  FROM {prefix}placed JOIN {prefix}numbered USING (stratum, idx)
)"""


def _cycle_text(groups: str) -> str:
    return f"""
SELECT trait AS cycle,
       coalesce(array_to_string(list_sort(array_agg(species) FILTER (grp = 1)), ','), '') AS fg,
       array_to_string(list_sort(array_agg(species) FILTER (grp = 0)), ',') AS bg
FROM {groups} GROUP BY trait HAVING count(*) FILTER (grp = 0) > 0"""


_CUSTOMER_POOL = """
pool AS (SELECT '' AS stratum, c_name AS species FROM customer),
quotas AS (SELECT '' AS stratum, 5 AS n_fg, 4 AS n_bg)"""

_FAMILY_POOL = """
pool AS (SELECT n_name AS stratum, c_name AS species FROM customer JOIN nation ON c_nationkey = n_nationkey),
template AS (SELECT c_name AS species, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS grp
             FROM customer WHERE c_acctbal > 9500 OR c_acctbal < -500),
quotas AS (SELECT stratum, count(*) FILTER (grp = 1) AS n_fg, count(*) FILTER (grp = 0) AS n_bg
           FROM template JOIN pool USING (species) GROUP BY stratum)"""

_SPECIES_POOL = """
pool AS (SELECT DISTINCT '' AS stratum, 'sp' || lpad(CAST(p_partkey % 100 AS VARCHAR), 3, '0') AS species FROM part),
quotas AS (SELECT '' AS stratum, 4 AS n_fg, 3 AS n_bg)"""

_PERMUTED = """
permuted AS (
  SELECT 'b_' || l_suppkey AS cycle, 'sp' || lpad(CAST(l_partkey % 100 AS VARCHAR), 3, '0') AS species,
         sum(l_quantity) % 50 + 1 AS value
  FROM lineitem GROUP BY ALL
),
species_values AS (
  SELECT 'sp' || lpad(CAST(p_partkey % 100 AS VARCHAR), 3, '0') AS species,
         CAST(sum(p_size) % 50 + 1 AS DOUBLE) AS value
  FROM part GROUP BY 1
),
candidates AS (
  SELECT cycle, grp, p.species, p.value
  FROM permuted p JOIN (SELECT DISTINCT grp, value FROM species_values JOIN size_groups USING (species)) t
    ON p.value = t.value
)"""


def _select(fg_order: str, bg_order: str) -> str:
    return (
        _with(
            _SIZE_GROUPS,
            _PERMUTED,
            f"""
ranked AS (
  SELECT cycle AS trait, grp, species,
         CASE WHEN grp = 1 THEN row_number() OVER (PARTITION BY cycle, grp ORDER BY {fg_order}, species)
              ELSE row_number() OVER (PARTITION BY cycle, grp ORDER BY {bg_order}, species) END AS nth
  FROM candidates
),
chosen AS (SELECT * FROM ranked WHERE nth <= CASE WHEN grp = 1 THEN 4 ELSE 3 END)""",
        )
        + _cycle_text("chosen")
    )


def _bootstrap(patterns: str, threshold: int, bounds: str) -> str:
    return (
        _with(_LINE_CELLS, _SPECIES_POOL, _sample("pool", "quotas", 1000), _PROFILE, _evidence("drawn"))
        + f"""
SELECT gene || '@' || pos AS position, CAST(count(trait) AS INT) AS count, 1000 AS cycles,
       round(count(trait) / 1000, 9) AS empval,
       coalesce(array_to_string(list_sort(array_agg(trait) FILTER (trait IS NOT NULL)), ','), '') AS cycle_list,
       'size' AS trait_config
FROM profile p LEFT JOIN (
  SELECT gene, pos, trait FROM judged WHERE is_hit AND pattern IN ({patterns}) AND {bounds}
) h USING (gene, pos)
WHERE gaps / total <= 0.5 AND minority >= {threshold}
GROUP BY gene, pos"""
    )


def _excess(observed: str, groups_cte: list[str], patterns: str, threshold: int, bounds: str) -> str:
    return (
        _with(
            _LINE_CELLS, _SPECIES_POOL, _sample("pool", "quotas", 1000), *groups_cte, _PROFILE,
            f"""
everyone AS (
  SELECT 'o' || trait AS trait, species, grp FROM ({observed})
  UNION ALL SELECT 'c' || trait, species, grp FROM drawn
)""",
            _evidence("everyone"),
            f"""
hit_numbers AS (
  SELECT w.trait, count(h.pos) AS n_hits
  FROM (SELECT DISTINCT trait FROM everyone) w LEFT JOIN (
    SELECT gene, pos, trait FROM judged JOIN profile USING (gene, pos)
    WHERE is_hit AND pattern IN ({patterns}) AND {bounds} AND gaps / total <= 0.5 AND minority >= {threshold}
  ) h USING (trait) GROUP BY 1
)""",
        )
        + """
SELECT substr(o.trait, 2) AS trait, o.n_hits, 1000 AS cycles, count(*) FILTER (c.n_hits >= o.n_hits) AS n_at_least,
       round((count(*) FILTER (c.n_hits >= o.n_hits) + 1) / 1001, 9) AS pvalue
FROM hit_numbers o, hit_numbers c WHERE o.trait LIKE 'o%' AND c.trait LIKE 'c%' GROUP BY o.trait, o.n_hits"""
    )


_TREE = """
lines AS (
  SELECT 'c' || o_custkey AS tree, 'o' || o_orderkey AS ord,
         'l_' || l_orderkey || '_' || l_linenumber AS tip,
         CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS olen, max(l_quantity) AS llen
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
)"""

_FARTHEST = """
pairs AS (
  SELECT x.tree, x.tip AS a, y.tip AS b,
         x.llen + y.llen + CASE WHEN x.ord = y.ord THEN 0 ELSE x.olen + y.olen END AS d
  FROM lines x JOIN lines y ON x.tree = y.tree AND x.tip < y.tip
),
best AS (
  SELECT tree, a AS farthest, b AS partner, d AS max_distance FROM (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY d DESC, a DESC, b DESC) AS nth FROM pairs
  ) WHERE nth = 1
)"""

ORACLE: dict[str, str] = {
    "position_symbols": _with(_LINE_CELLS) + "SELECT gene, species, pos, symbol FROM cells",
    "gene_species": _with(_LINE_CELLS) + "SELECT gene, species FROM members_of",
    "symbol_histogram": _with(_LINE_CELLS, _PROFILE) + "SELECT gene, pos, symbol, n FROM solid_hist",
    "column_profile": _with(_LINE_CELLS, _PROFILE)
    + "SELECT gene, pos, total, CAST(gaps AS BIGINT) AS gaps, CAST(nongap AS BIGINT) AS nongap, n_symbols, top, "
    "CAST(minority AS BIGINT) AS minority FROM profile",
    "slice_positions": _with(_LINE_CELLS, _PROFILE)
    + "SELECT gene, pos, CAST(gaps AS BIGINT) AS gaps, CAST(minority AS BIGINT) AS minority FROM profile "
    "WHERE gaps / total <= 0.5 AND minority >= 20",
    "symbol_species": _with(_LINE_CELLS)
    + "SELECT gene, pos, symbol, string_agg(species, ',' ORDER BY species) AS species "
    "FROM cells GROUP BY gene, pos, symbol",
    "symbol_traits": _with(_LINE_CELLS, _NATION_GROUPS)
    + "SELECT DISTINCT gene, pos, symbol, trait, grp FROM cells JOIN nation_groups USING (species)",
    "group_sizes": _with(_LABEL_GROUPS)
    + "SELECT trait, count(*) FILTER (grp = 1) AS n_fg, count(*) FILTER (grp = 0) AS n_bg FROM label_groups GROUP BY 1",
    "missing_species": _with(_LINE_CELLS, _NATION_GROUPS, _evidence("nation_groups"))
    + "SELECT gene, trait, CAST(mfg AS INT) AS mfg, CAST(mbg AS INT) AS mbg, missing FROM lacking",
    "group_evidence": _with(_LINE_CELLS, _NATION_GROUPS, _evidence("nation_groups"))
    + "SELECT gene, pos, trait, array_to_string(fgs, ',') AS fg_symbols, array_to_string(bgs, ',') AS bg_symbols, "
    "ffgn, fbgn, gfg, gbg FROM judged",
    "verdict": _with(_LINE_CELLS, _NATION_GROUPS, _evidence("nation_groups"))
    + "SELECT gene, pos, trait, array_to_string(fgs, '') || '/' || array_to_string(bgs, '') AS tag, is_hit, pattern, "
    "is_hit AND pattern IN (1, 2, 3) AS admitted FROM judged",
    "position_pvalue": _with(_LINE_CELLS, _PROFILE, _pvalue("solid_hist", "4", "3", "gene, pos"))
    + "SELECT gene, pos, pvalue FROM pvalues JOIN profile USING (gene, pos) "
    "WHERE gaps / total <= 0.5 AND minority >= 3",
    "position_pvalue_even": _with(_LINE_CELLS, _PROFILE, _pvalue("solid_hist", "3", "3", "gene, pos"))
    + "SELECT gene, pos, pvalue FROM pvalues JOIN profile USING (gene, pos) "
    "WHERE gaps / total <= 0.5 AND minority >= 3",
    "discovery": _discovery(_LINE_CELLS, _SIZE_GROUPS, "size_groups"),
    "batch_discovery": _BATCH,
    "bounded_discovery": _discovery(
        _LINE_CELLS,
        _NATION_GROUPS,
        "nation_groups",
        patterns="1, 2, 3, 4",
        ratio="0.45",
        threshold="least(n_fg - 3, n_bg - 1)",
        bounds="gfg <= 2 AND gbg <= 1 AND gfg + gbg <= 2 AND mfg <= 1 AND mbg <= 0 AND mfg + mbg <= 1",
    ),
    "batch_hits_per_job": _with(
        _LINE_CELLS, _NATION_GROUPS, _PROFILE, _evidence("nation_groups"),
        _hits("1, 2, 3", "0.5", "least(n_fg, n_bg)", "true"),
    )
    + """
SELECT g.gene, t.trait, count(h.pos) AS n_hits
FROM (SELECT DISTINCT gene FROM members_of) g CROSS JOIN (SELECT DISTINCT trait FROM nation_groups) t
LEFT JOIN hits h ON h.gene = g.gene AND h.trait = t.trait
GROUP BY 1, 2""",
    "document_profile": _with(_DOCUMENT_CELLS, _PROFILE)
    + "SELECT gene, pos, total, CAST(gaps AS BIGINT) AS gaps, CAST(nongap AS BIGINT) AS nongap, n_symbols, top, "
    "CAST(minority AS BIGINT) AS minority FROM profile",
    "document_discovery": _discovery(_DOCUMENT_CELLS, _LABEL_GROUPS, "label_groups"),
    "resample_random": _with(_CUSTOMER_POOL, _sample("pool", "quotas", 200)) + _cycle_text("drawn"),
    "resample_family": _with(_FAMILY_POOL, _sample("pool", "quotas", 200)) + _cycle_text("drawn"),
    "select_inner": _select("value DESC", "value"),
    "select_edges": _select("value", "value DESC"),
    "select_random": _select(*["md5(concat_ws('|', '7', cycle, grp, species))"] * 2),
    "cycles_to_configs": _with(_CUSTOMER_POOL, _sample("pool", "quotas", 200))
    + "SELECT trait, species, grp FROM drawn WHERE cycle_no <= 10",
    "bootstrap": _bootstrap("1, 2, 3", 3, "true"),
    "bootstrap_bounded": _bootstrap("1, 2", 2, "gfg <= 1 AND gbg <= 1 AND mfg + mbg <= 0"),
    "excess": _excess(
        "SELECT * FROM size_groups UNION ALL SELECT * FROM nation_groups", [_SIZE_GROUPS, _NATION_GROUPS], "1, 2, 3", 3, "true"
    ),
    "excess_bounded": _excess(
        "SELECT * FROM nation_groups", [_NATION_GROUPS], "1, 3", 2, "gbg <= 1 AND gfg + gbg <= 2 AND mfg <= 0 AND mfg + mbg <= 1"
    ),
    "newick_edges": _with(_TREE)
    + """
SELECT tree, tip AS label, ord AS parent_label, llen AS length, true AS is_tip FROM lines
UNION ALL
SELECT DISTINCT tree, ord, tree, olen, false FROM lines
UNION ALL
SELECT DISTINCT tree, tree, NULL, 0.0, false FROM lines""",
    "tree_tips": _with(_TREE) + "SELECT tree, tip AS species FROM lines",
    "farthest_tip": _with(_TREE, _FARTHEST) + "SELECT * FROM best",
    "distances_from_farthest": _with(_TREE, _FARTHEST)
    + """
SELECT x.tree, y.tip AS species,
       CASE WHEN x.tip = y.tip THEN 0.0
            ELSE x.llen + y.llen + CASE WHEN x.ord = y.ord THEN 0 ELSE x.olen + y.olen END END AS d
FROM best b JOIN lines x ON x.tree = b.tree AND x.tip = b.farthest JOIN lines y ON y.tree = b.tree""",
    "patristic_distance": _with(_TREE)
    + """
SELECT tree, least(tip, other) || '@' || greatest(tip, other) AS pair,
       llen + other_llen + CASE WHEN ord = other_ord THEN 0 ELSE olen + other_olen END AS d
FROM (
  SELECT *, lead(tip) OVER w AS other, lead(ord) OVER w AS other_ord,
         lead(llen) OVER w AS other_llen, lead(olen) OVER w AS other_olen
  FROM lines WINDOW w AS (PARTITION BY tree ORDER BY tip)
) WHERE other IS NOT NULL""",
}


_CLASS_RECORDS = """
class_records AS (
  SELECT 'c' || CAST(substr(gene, 2) AS BIGINT) % 10 AS gene, gene || '_' || species AS species,
         string_agg(symbol, '' ORDER BY pos) AS seq
  FROM cells GROUP BY cells.gene, cells.species
)"""

_READ_BACK = _with(_LINE_CELLS, _CLASS_RECORDS) + "SELECT gene, species, seq FROM class_records"

#: Files of every format give back what was written, so their statements do not mention files.
ORACLE |= {
    **dict.fromkeys(("fasta_files", "phylip_files", "clustal_files", "stockholm_files"), _READ_BACK),
    "file_manifest": _with(_LINE_CELLS, _CLASS_RECORDS)
    + "SELECT gene AS name, 1::BIGINT AS files, CAST(sum(length('>' || species || ' a note > more') + length(seq) + 3) AS BIGINT) AS bytes "
    "FROM class_records GROUP BY gene",
    "path_names": """
SELECT page_id, split_part(name, '.', 1) AS gene, name AS trait,
       CASE WHEN strpos(name[2:], '.') > 0 THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS job
FROM (SELECT page_id, split_part(url, '/', -1) AS name FROM pages)""",
    "trait_files": _with(_LABEL_GROUPS) + "SELECT DISTINCT trait, species, grp FROM label_groups",
    "cycle_files": _with(_CUSTOMER_POOL, _sample("pool", "quotas", 200))
    + "SELECT trait, species, grp, 200 AS cycles FROM drawn",
    "cycle_config_files": ORACLE["cycles_to_configs"],
    "family_files": _with(_FAMILY_POOL) + "SELECT species, stratum AS family FROM pool",
    "value_files": """
SELECT 'p' || p_partkey AS species, p_retailprice AS value,
       CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size % 3 - 1 AS INT) END AS label
FROM part WHERE p_partkey % 7 <> 0""",
    "bootstrap_files": ORACLE["bootstrap"],
    "discovery_files": ORACLE["batch_discovery"],
    "job_folders": _with(
        _LINE_CELLS, _NATION_GROUPS, _PROFILE, _evidence("nation_groups"), _hits("1, 2, 3", "0.5", "least(n_fg, n_bg)", "true")
    )
    + """
SELECT 'c' || CAST(substr(gene, 2) AS BIGINT) % 10 AS "Gene", trait AS "Trait", count(*) AS n_hits, max(pos) AS last
FROM hits GROUP BY 1, 2""",
    "sorted_from_farthest": ORACLE["distances_from_farthest"],
}
