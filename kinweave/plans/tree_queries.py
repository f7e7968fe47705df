"""Queries of the tree operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import graphs, trees
from kinweave.plans.adapters import sql, workspace

TEXT = "ів"
YEAR = 1850


def _trees(name: str):
    f = getattr(trees, name)

    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(workspace(spark, d))

    return run


def b_search_name(spark: SparkSession, d: str) -> DataFrame:
    return trees.search_by_name(workspace(spark, d), TEXT)


def b_resolve_person(spark: SparkSession, d: str) -> DataFrame:
    return trees.resolve_person(workspace(spark, d), TEXT)


def b_resolve_tree(spark: SparkSession, d: str) -> DataFrame:
    return trees.resolve_tree(workspace(spark, d), "MAIN tree")


def b_find_person(spark: SparkSession, d: str) -> DataFrame:
    return trees.find_persons(workspace(spark, d), "ов", place="ів", year_from=1700, year_to=1900)


def b_find_person_by_relatives(spark: SparkSession, d: str) -> DataFrame:
    return trees.find_persons(workspace(spark, d), "о", father="о", child="а")


def b_get_person(spark: SparkSession, d: str) -> DataFrame:
    """Every person with the primary name, if there is one."""
    ws = workspace(spark, d)
    primary = ws.name.filter("is_primary").groupBy("tree_id", "person_id").agg(F.min(F.struct("person_name_id", "full_name"))["full_name"].alias("primary_name"))
    return ws.person.select("tree_id", "person_id", "external_id", "sex", "is_living", "display_name").join(primary, ["tree_id", "person_id"], "left")


def b_list_trees(spark: SparkSession, d: str) -> DataFrame:
    return workspace(spark, d).tree.orderBy("name")


def b_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return graphs.ancestors(workspace(spark, d))


def b_descendants(spark: SparkSession, d: str) -> DataFrame:
    return graphs.descendants(workspace(spark, d))


def b_person_tree(spark: SparkSession, d: str) -> DataFrame:
    return graphs.person_tree(workspace(spark, d), up=True)


def b_descendants_at_year(spark: SparkSession, d: str) -> DataFrame:
    return graphs.descendants_at_year(workspace(spark, d), YEAR)


def _couples(ws) -> DataFrame:
    return ws.family.select("tree_id", F.col("family_id").alias("pair_id"), F.col("spouse1_id").alias("a_id"), F.col("spouse2_id").alias("b_id"))


def b_common_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """Closest common ancestor of every two siblings-in-line: each person and the smallest of its cousins by a shared grandparent."""
    ws = workspace(spark, d)
    return graphs.common_ancestors(ws, _cousins(ws))


def _cousins(ws) -> DataFrame:
    """One pair per grandparent: the smallest and the greatest of its grandchildren."""
    up = ws.parent.select("tree_id", F.col("child_id").alias("person_id"), F.col("parent_id").alias("mid"))
    grand = up.join(ws.parent.select("tree_id", F.col("child_id").alias("mid"), F.col("parent_id").alias("grand_id")), ["tree_id", "mid"])
    pairs = grand.groupBy("tree_id", "grand_id").agg(F.min("person_id").alias("a_id"), F.max("person_id").alias("b_id")).filter("a_id <> b_id")
    return pairs.select("tree_id", F.col("grand_id").alias("pair_id"), "a_id", "b_id")


def b_paths_between(spark: SparkSession, d: str) -> DataFrame:
    ws = workspace(spark, d)
    return graphs.paths_between(ws, _cousins(ws), 8).select("tree_id", "pair_id", "steps")


def a_root_candidates(spark: SparkSession, d: str) -> DataFrame:
    return graphs.closure_counts(workspace(spark, d))


def b_scope_validation(spark: SparkSession, d: str) -> DataFrame:
    ws = workspace(spark, d)
    roots = ws.parent.groupBy("tree_id").agg(F.max("child_id").alias("root_id"))
    return graphs.validate_scope(ws, roots)


def b_bounded_context(spark: SparkSession, d: str) -> DataFrame:
    """Relatives up to three generations up and two down at their least distance."""
    ws = workspace(spark, d)
    up = graphs.nearest(ws.parent, True, 3).withColumn("direction", F.lit("up"))
    return up.unionByName(graphs.nearest(ws.parent, False, 2).withColumn("direction", F.lit("down")))


QUERIES = {
    f.__name__: f
    for f in (
        b_search_name, b_resolve_person, b_resolve_tree, b_find_person, b_find_person_by_relatives, b_get_person, b_list_trees, b_ancestors, b_descendants, b_person_tree,
        b_descendants_at_year, b_common_ancestor, b_paths_between, a_root_candidates, b_scope_validation, b_bounded_context,
    )
} | {f"b_{n}": _trees(n) for n in ("life_events", "family_context", "rich_parents", "rich_siblings", "rich_marriages", "rich_children", "person_counts")}

_LIFE = """births AS (
  SELECT tree_id, person_id, year_from AS birth_year, place_raw AS birth_place FROM event_v WHERE event_type IN ('BIRT', 'CHR') QUALIFY row_number() OVER (PARTITION BY tree_id, person_id ORDER BY (event_type = 'CHR'), year_from NULLS LAST, event_id) = 1
), deaths AS (
  SELECT tree_id, person_id, year_from AS death_year, place_raw AS death_place FROM event_v WHERE event_type = 'DEAT' QUALIFY row_number() OVER (PARTITION BY tree_id, person_id ORDER BY year_from NULLS LAST, event_id) = 1
)"""
_SPOUSE = """spouse_v AS (
  SELECT tree_id, spouse1_id AS person_id, spouse2_id AS spouse_id, family_id, marriage_year, marriage_place FROM family_v
  UNION ALL SELECT tree_id, spouse2_id, spouse1_id, family_id, marriage_year, marriage_place FROM family_v
)"""


def _named(alias: str, text: str) -> str:
    return f"EXISTS (SELECT 1 FROM name_v n WHERE n.tree_id = {alias}.tree_id AND n.person_id = {alias}.person_id AND (contains(lower(n.full_name_normalized), '{text}') OR contains(lower(n.surname), '{text}')))"


def _walk(up: bool, generations: int) -> str:
    a, b = ("child_id", "parent_id") if up else ("parent_id", "child_id")
    return f"""walk AS (
  SELECT tree_id, {a} AS start_id, {b} AS person_id, 1 AS generation, {a} || '>' || {b} AS path FROM parent_v
  UNION ALL
  SELECT w.tree_id, w.start_id, p.{b}, w.generation + 1, w.path || '>' || p.{b} FROM walk w JOIN parent_v p ON p.tree_id = w.tree_id AND p.{a} = w.person_id WHERE w.generation < {generations} AND NOT list_contains(string_split(w.path, '>'), p.{b})
)"""


_PERSON_COLUMNS = "name, sex, birth_year, birth_place, death_year, death_place"
_COUSINS = """cousins AS (
  SELECT x.tree_id, y.parent_id AS pair_id, min(x.child_id) AS a_id, max(x.child_id) AS b_id FROM parent_v x JOIN parent_v y ON y.tree_id = x.tree_id AND y.child_id = x.parent_id GROUP BY ALL HAVING min(x.child_id) <> max(x.child_id)
)"""

ORACLE = {
    "b_search_name": sql(f"SELECT tree_id, person_id, display_name FROM person_v p WHERE {_named('p', TEXT)}"),
    "b_resolve_person": sql(
        f"""SELECT * FROM (SELECT tree_id, person_id, display_name, is_exact, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY is_exact DESC, display_name NULLS LAST, person_id) AS INTEGER) AS rank
        FROM (SELECT tree_id, person_id, bool_or(lower(full_name_normalized) = '{TEXT}' OR lower(coalesce(surname, '')) = '{TEXT}') AS is_exact FROM name_v WHERE contains(lower(full_name_normalized), '{TEXT}') OR contains(lower(surname), '{TEXT}') GROUP BY ALL)
        JOIN person_v USING (tree_id, person_id)) WHERE rank <= 10"""
    ).replace("SELECT * FROM (SELECT tree_id, person_id, display_name", "SELECT tree_id, person_id, display_name, is_exact, rank FROM (SELECT tree_id, person_id, display_name"),
    "b_resolve_tree": sql("SELECT tree_id, name FROM tree_v WHERE tree_id = 'main tree' OR lower(name) = 'main tree'"),
    "b_list_trees": sql("SELECT tree_id, name FROM tree_v"),
    "b_person_counts": sql("SELECT t.tree_id, t.name, count(p.person_id) AS persons FROM tree_v t LEFT JOIN person_v p USING (tree_id) GROUP BY ALL"),
    "b_get_person": sql(
        "SELECT p.tree_id, p.person_id, external_id, sex, is_living, display_name, n.full_name AS primary_name FROM person_v p LEFT JOIN (SELECT tree_id, person_id, arg_min(full_name, person_name_id) AS full_name FROM name_v WHERE is_primary GROUP BY ALL) n USING (tree_id, person_id)"
    ),
    "b_find_person": sql(
        f"""SELECT p.tree_id, p.person_id, display_name, b.birth_year, birth_place, death_year, death_place FROM person_v p LEFT JOIN births b USING (tree_id, person_id) LEFT JOIN deaths d USING (tree_id, person_id)
        WHERE {_named('p', 'ов')} AND EXISTS (SELECT 1 FROM event_v e WHERE e.tree_id = p.tree_id AND e.person_id = p.person_id AND (contains(lower(place_raw), 'ів') OR contains(lower(place_normalized), 'ів')))
        AND EXISTS (SELECT 1 FROM event_v e WHERE e.tree_id = p.tree_id AND e.person_id = p.person_id AND event_type = 'BIRT' AND coalesce(year_from, year_to) >= 1700)
        AND EXISTS (SELECT 1 FROM event_v e WHERE e.tree_id = p.tree_id AND e.person_id = p.person_id AND event_type = 'BIRT' AND coalesce(year_from, year_to) <= 1900)""",
        _LIFE,
    ),
    "b_find_person_by_relatives": sql(
        f"""SELECT p.tree_id, p.person_id, display_name, b.birth_year, birth_place, death_year, death_place FROM person_v p LEFT JOIN births b USING (tree_id, person_id) LEFT JOIN deaths d USING (tree_id, person_id)
        WHERE {_named('p', 'о')} AND EXISTS (SELECT 1 FROM parent_v e JOIN person_v f ON f.tree_id = e.tree_id AND f.person_id = e.parent_id WHERE e.tree_id = p.tree_id AND e.child_id = p.person_id AND f.sex = 'M' AND {_named('f', 'о')})
        AND EXISTS (SELECT 1 FROM parent_v e JOIN person_v f ON f.tree_id = e.tree_id AND f.person_id = e.child_id WHERE e.tree_id = p.tree_id AND e.parent_id = p.person_id AND {_named('f', 'а')})""",
        _LIFE,
    ),
    "b_life_events": sql(
        """SELECT e.tree_id, e.person_id, CAST(row_number() OVER (PARTITION BY e.tree_id, e.person_id ORDER BY coalesce(year_from, 9999), date_from NULLS LAST,
        CASE event_type WHEN 'BIRT' THEN 1 WHEN 'BAPT' THEN 2 WHEN 'CHR' THEN 2 WHEN 'MARR' THEN 3 WHEN 'DEAT' THEN 4 WHEN 'BURI' THEN 5 ELSE 9 END, event_id) AS INTEGER) AS position, event_id, event_type, date_raw, year_from, place_raw, r.display_name AS related_name
        FROM event_v e LEFT JOIN person_v r ON r.tree_id = e.tree_id AND r.person_id = e.related_id"""
    ),
    "b_family_context": sql(
        """SELECT x.*, r.display_name AS name FROM (SELECT tree_id, child_id AS person_id, 'parent' AS relation, parent_id AS relative_id FROM parent_v UNION ALL SELECT tree_id, parent_id, 'child', child_id FROM parent_v UNION ALL SELECT tree_id, person_id, 'spouse', spouse_id FROM spouse_v) x
        JOIN person_v r ON r.tree_id = x.tree_id AND r.person_id = x.relative_id""",
        _SPOUSE,
    ),
    "b_rich_parents": sql(
        f"""SELECT tree_id, child_id AS person_id, CAST(row_number() OVER (PARTITION BY tree_id, child_id ORDER BY sex DESC NULLS LAST, birth_year NULLS LAST, parent_id) AS INTEGER) AS position, parent_id, {_PERSON_COLUMNS}
        FROM (SELECT e.tree_id, e.child_id, e.parent_id, p.display_name AS name, p.sex, b.birth_year, birth_place, death_year, death_place FROM parent_v e JOIN person_v p ON p.tree_id = e.tree_id AND p.person_id = e.parent_id LEFT JOIN births b ON b.tree_id = e.tree_id AND b.person_id = e.parent_id LEFT JOIN deaths d ON d.tree_id = e.tree_id AND d.person_id = e.parent_id)""",
        _LIFE,
    ),
    "b_rich_siblings": sql(
        "SELECT s.*, p.display_name AS name, p.sex, b.birth_year, d.death_year FROM (SELECT DISTINCT x.tree_id, x.child_id AS person_id, y.child_id AS sibling_id FROM parent_v x JOIN parent_v y ON x.tree_id = y.tree_id AND x.parent_id = y.parent_id AND x.child_id <> y.child_id) s JOIN person_v p ON p.tree_id = s.tree_id AND p.person_id = s.sibling_id LEFT JOIN births b ON b.tree_id = s.tree_id AND b.person_id = s.sibling_id LEFT JOIN deaths d ON d.tree_id = s.tree_id AND d.person_id = s.sibling_id",
        _LIFE,
    ),
    "b_rich_marriages": sql(
        "SELECT s.tree_id, s.person_id, family_id, spouse_id, p.display_name AS name, b.birth_year, d.death_year, marriage_year, marriage_place FROM spouse_v s JOIN person_v p ON p.tree_id = s.tree_id AND p.person_id = s.spouse_id LEFT JOIN births b ON b.tree_id = s.tree_id AND b.person_id = s.spouse_id LEFT JOIN deaths d ON d.tree_id = s.tree_id AND d.person_id = s.spouse_id",
        _LIFE, _SPOUSE,
    ),
    "b_rich_children": sql(
        "SELECT e.tree_id, e.parent_id AS person_id, e.child_id, p.display_name AS name, p.sex, b.birth_year, d.death_year, (SELECT min(o.parent_id) FROM parent_v o WHERE o.tree_id = e.tree_id AND o.child_id = e.child_id AND o.parent_id <> e.parent_id) AS other_parent_id FROM parent_v e JOIN person_v p ON p.tree_id = e.tree_id AND p.person_id = e.child_id LEFT JOIN births b ON b.tree_id = e.tree_id AND b.person_id = e.child_id LEFT JOIN deaths d ON d.tree_id = e.tree_id AND d.person_id = e.child_id",
        _LIFE,
    ),
    "b_ancestors": sql(
        "SELECT w.*, p.display_name AS name, p.sex, b.birth_year, birth_place, death_year, death_place FROM (SELECT DISTINCT tree_id, start_id AS person_id, person_id AS ancestor_id, generation FROM walk) w JOIN person_v p ON p.tree_id = w.tree_id AND p.person_id = w.ancestor_id LEFT JOIN births b ON b.tree_id = w.tree_id AND b.person_id = w.ancestor_id LEFT JOIN deaths d ON d.tree_id = w.tree_id AND d.person_id = w.ancestor_id",
        _walk(True, 6), _LIFE, recursive=True,
    ),
    "b_descendants": sql(
        "SELECT w.tree_id, w.start_id AS ancestor_id, w.person_id AS descendant_id, string_split(path, '>')[-2] AS parent_id, generation, p.display_name AS name FROM walk w JOIN person_v p ON p.tree_id = w.tree_id AND p.person_id = w.person_id",
        _walk(False, 8), recursive=True,
    ),
    "b_person_tree": sql(
        "SELECT tree_id, start_id AS root_id, person_id, string_split(path, '>')[-2] AS from_id, generation, path FROM walk UNION ALL SELECT tree_id, person_id, person_id, NULL, 0, person_id FROM person_v",
        _walk(True, 6), recursive=True,
    ),
    "b_descendants_at_year": sql(
        f"""SELECT tree_id, ancestor_id, person_id, generation, 'DESCENDANT' AS role FROM kin
        UNION ALL SELECT DISTINCT k.tree_id, k.ancestor_id, s.spouse_id, k.generation, 'SPOUSE' FROM kin k JOIN spouse_v s ON s.tree_id = k.tree_id AND s.person_id = k.person_id LEFT JOIN years y ON y.tree_id = s.tree_id AND y.person_id = s.spouse_id
        WHERE (marriage_year IS NULL OR marriage_year <= {YEAR}) AND (born IS NULL OR born <= {YEAR}) AND (died IS NULL OR died >= {YEAR})""",
        _walk(False, 8), _SPOUSE,
        "years AS (SELECT tree_id, person_id, min(coalesce(year_from, year_to)) FILTER (event_type = 'BIRT') AS born, min(coalesce(year_from, year_to)) FILTER (event_type = 'DEAT') AS died FROM event_v WHERE event_type IN ('BIRT', 'DEAT') GROUP BY ALL)",
        f"kin AS (SELECT w.* FROM (SELECT tree_id, start_id AS ancestor_id, person_id, min(generation) AS generation FROM walk GROUP BY ALL) w LEFT JOIN years y USING (tree_id, person_id) WHERE (born IS NULL OR born <= {YEAR}) AND (died IS NULL OR died >= {YEAR}))",
        recursive=True,
    ),
    "b_common_ancestor": sql(
        """SELECT tree_id, pair_id, ancestor_id, depth_a, depth_b FROM (
          SELECT c.tree_id, c.pair_id, a.person_id AS ancestor_id, a.depth AS depth_a, b.depth AS depth_b FROM cousins c JOIN up a ON a.tree_id = c.tree_id AND a.start_id = c.a_id JOIN up b ON b.tree_id = c.tree_id AND b.start_id = c.b_id AND b.person_id = a.person_id
        ) QUALIFY row_number() OVER (PARTITION BY tree_id, pair_id ORDER BY greatest(depth_a, depth_b), depth_a + depth_b, ancestor_id) = 1""",
        _walk(True, 12), _COUSINS,
        "up AS (SELECT tree_id, start_id, person_id, min(generation) AS depth FROM walk GROUP BY ALL UNION ALL SELECT tree_id, person_id, person_id, 0 FROM person_v)",
        recursive=True,
    ),
    "b_paths_between": sql(
        "SELECT tree_id, pair_id, min(depth)::INT AS steps FROM reach WHERE cur = b_id GROUP BY ALL",
        _COUSINS, "steps AS (SELECT tree_id, parent_id AS a, child_id AS b FROM parent_v UNION SELECT tree_id, child_id, parent_id FROM parent_v)",
        "reach AS (SELECT tree_id, pair_id, b_id, a_id AS cur, 0 AS depth FROM cousins UNION SELECT r.tree_id, r.pair_id, r.b_id, s.b, r.depth + 1 FROM reach r JOIN steps s ON s.tree_id = r.tree_id AND s.a = r.cur WHERE r.depth < 8 AND r.cur <> r.b_id)",
        recursive=True,
    ),
    "b_bounded_context": sql(
        "SELECT tree_id, start_id, person_id, min(generation) AS generation, 'up' AS direction FROM walk GROUP BY ALL UNION ALL SELECT tree_id, start_id, person_id, min(generation), 'down' FROM walk2 GROUP BY ALL",
        _walk(True, 3), _walk(False, 2).replace("walk", "walk2"), recursive=True,
    ),
    "a_root_candidates": sql(
        "SELECT tree_id, start_id AS person_id, count(*) AS descendants FROM reach GROUP BY ALL",
        "reach AS (SELECT tree_id, parent_id AS start_id, child_id AS person_id FROM parent_v p WHERE NOT EXISTS (SELECT 1 FROM parent_v q WHERE q.tree_id = p.tree_id AND q.child_id = p.parent_id) UNION SELECT r.tree_id, r.start_id, p.child_id FROM reach r JOIN parent_v p ON p.tree_id = r.tree_id AND p.parent_id = r.person_id)",
        recursive=True,
    ),
    "b_scope_validation": sql(
        """SELECT p.tree_id, p.person_id, CASE WHEN EXISTS (SELECT 1 FROM blood b WHERE b.tree_id = p.tree_id AND b.person_id = p.person_id) THEN 'BLOOD' WHEN EXISTS (SELECT 1 FROM spouses b WHERE b.tree_id = p.tree_id AND b.person_id = p.person_id) THEN 'SPOUSE'
        WHEN EXISTS (SELECT 1 FROM spouses b JOIN parent_v e ON e.tree_id = b.tree_id AND e.child_id = b.person_id WHERE e.tree_id = p.tree_id AND e.parent_id = p.person_id) THEN 'SPOUSE_PARENT' ELSE 'INVALID' END AS scope FROM person_v p WHERE p.tree_id IN (SELECT tree_id FROM roots)""",
        "roots AS (SELECT tree_id, max(child_id) AS root_id FROM parent_v GROUP BY ALL)",
        "ups AS (SELECT tree_id, root_id AS person_id FROM roots UNION SELECT u.tree_id, p.parent_id FROM ups u JOIN parent_v p ON p.tree_id = u.tree_id AND p.child_id = u.person_id)",
        "blood AS (SELECT * FROM ups UNION SELECT u.tree_id, p.child_id FROM blood u JOIN parent_v p ON p.tree_id = u.tree_id AND p.parent_id = u.person_id)",
        _SPOUSE, "spouses AS (SELECT DISTINCT s.tree_id, s.spouse_id AS person_id FROM spouse_v s JOIN blood b ON b.tree_id = s.tree_id AND b.person_id = s.person_id)",
        recursive=True,
    ),
}
