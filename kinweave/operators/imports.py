"""Import of a staged snapshot: change preview, duplicate scoring, readiness and apply."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.operators.merges import insert_missing, merge_snapshot, or_equi_join

PERSON_COLUMNS = ["external_id", "sex", "is_living", "display_name", "surname_normalized"]
EVENT_ATTRIBUTES = ["event_value", "date_raw", "year_from", "year_to"]


FAMILY_COLUMNS = ["spouse1_id", "spouse2_id", "marriage_date_raw", "marriage_year", "marriage_place", "notes"]
EVENT_COLUMNS = ["event_type", "event_value", "date_raw", "date_from", "date_to", "year_from", "year_to", "place_raw", "family_id", "related_id", "is_derived", "notes"]
#: States in which a batch may be applied.
APPLYABLE = ["STAGED", "PREVIEWED", "WAITING_FOR_CONFIRMATION"]


@dataclass(frozen=True)
class Snapshot:
    """One side of an import; columns beyond those named are carried along.

    person: tree_id, person_id and PERSON_COLUMNS.  name: tree_id, person_id, script_code,
    given, surname, full_name, full_name_normalized, is_primary.  parent: tree_id, parent_id,
    child_id, relation_type if known.  family: tree_id, family_id and those of FAMILY_COLUMNS
    that are known.  event: tree_id, person_id, event_key, row_id, place_normalized and those
    of EVENT_COLUMNS that are known.  place: place_raw.  citation: tree_id, person_id,
    event_key, source_origin, source_ref.  family_child: tree_id, family_id, child_id.
    parsed (staged names as parsed): tree_id, person_id, given, surname, full_name_normalized,
    parser_status, confidence.
    """

    person: DataFrame
    name: DataFrame
    parent: DataFrame
    family: DataFrame
    event: DataFrame
    place: DataFrame
    citation: DataFrame
    family_child: DataFrame | None = None
    parsed: DataFrame | None = None


def _edge_keys(*sides: Snapshot) -> list[str]:
    """Keys of parent edges; the type of relation is one where both sides know it."""
    typed = all("relation_type" in x.parent.columns for x in sides)
    return ["tree_id", "parent_id", "child_id"] + ["relation_type"] * typed


def _shared(columns: list[str], *frames: DataFrame) -> list[str]:
    return [c for c in columns if all(c in f.columns for f in frames)]


def _count(entity: str, change: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(entity).alias("entity"), F.lit(change).alias("change"), "rows")


def _difference(entity: str, stored: DataFrame, staged: DataFrame, keys: list[str], columns: list[str] | tuple = ()) -> DataFrame:
    """ADD, MISSING_FROM_IMPORT and, where ``columns`` differ, UPDATE counts of two sides from one full join; a missing value equals an empty one."""
    side = lambda df, name: df.select(*keys, *[F.coalesce(F.col(c).cast("string"), F.lit("false" if c == "is_living" else "")).alias(f"{name}{c}") for c in columns], F.lit(True).alias(f"{name}in"))
    both = side(stored, "_a_").join(side(staged, "_b_"), keys, "full")
    changed = reduce(lambda x, y: x | y, [F.col(f"_a_{c}") != F.col(f"_b_{c}") for c in columns], F.lit(False))
    change = F.when(F.col("_a_in").isNull(), "ADD").when(F.col("_b_in").isNull(), "MISSING_FROM_IMPORT").when(changed, "UPDATE")
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("rows")).filter("change is not null").select(F.lit(entity).alias("entity"), "change", "rows")


def _blank(df: DataFrame, places: DataFrame) -> DataFrame:
    """Events with comparable attributes: missing text is empty, a missing year or place has a number of its own."""
    ids = places.select("place_raw", F.col("place_id").alias("known_place"))
    return df.join(ids, "place_raw", "left").select(
        "tree_id", "person_id", "event_key", "event_type", "is_derived", "row_id",
        F.coalesce("event_value", F.lit("")).alias("event_value"), F.coalesce("date_raw", F.lit("")).alias("date_raw"),
        F.coalesce("year_from", F.lit(-32768)).alias("year_from"), F.coalesce("year_to", F.lit(-32768)).alias("year_to"),
        F.coalesce("known_place", F.lit(-1)).alias("place_id"), F.coalesce("place_raw", F.lit("")).alias("place_text"),
        F.coalesce("family_id", F.lit("")).alias("family_id"), F.coalesce("related_id", F.lit("")).alias("related_id"),
    )


def _matches(own: DataFrame, other: DataFrame, staged_first: bool, place: str) -> list[DataFrame]:
    """The other side's keys per way in which an event of one side may be known to the other."""
    on = ["tree_id", "person_id", *EVENT_ATTRIBUTES]
    stored, staged = (other, own) if staged_first else (own, other)
    keyless, key = stored.filter("event_key is null"), stored.filter("event_key is not null")
    by_key = (staged.filter("event_key is not null"), key, ["tree_id", "person_id", "event_key"])
    full = (staged, keyless, [*on, "event_type", place, "family_id", "related_id", "is_derived"])
    wed = (staged.filter("event_type = 'MARR' and is_derived"), keyless.filter("event_type = 'MARR' and not is_derived and family_id = ''"), [*on, place])
    christened = (staged.filter("event_type = 'CHR'"), keyless.filter("event_type = 'BIRT' and not is_derived"), [*on, place])
    died = (staged.filter("event_type = 'DEAT'"), keyless.filter("event_type = 'DEAT'"), [*on, "is_derived"])
    side = 0 if staged_first else 1
    return [(w[side].join(w[1 - side].select(*w[2]), w[2], "left_semi").select("row_id")) for w in (by_key, full, wed, christened, died)]


def preview(stored: Snapshot, staged: Snapshot) -> DataFrame:
    """(entity, change, rows) of everything that an import would change, changes with rows only."""
    p = ["tree_id", "person_id"]
    out = [
        _difference("Person", stored.person, staged.person, p, PERSON_COLUMNS),
        _difference("PersonName", stored.name, staged.name, [*p, "script_code", "full_name_normalized"]),
        _difference("ParentOf", stored.parent, staged.parent, _edge_keys(stored, staged)),
        _difference("Family", stored.family, staged.family, ["tree_id", "family_id"], _shared(FAMILY_COLUMNS, stored.family, staged.family)),
        _count("Place", "ADD", staged.place.select("place_raw").distinct().join(stored.place, "place_raw", "left_anti")),
    ]
    if stored.family_child is not None and staged.family_child is not None:
        out.append(_difference("FamilyChild", stored.family_child, staged.family_child, ["tree_id", "family_id", "child_id"]))
    pair = lambda f: f.select("tree_id", F.least("spouse1_id", "spouse2_id").alias("x"), F.greatest("spouse1_id", "spouse2_id").alias("y"))
    out.append(_count("SpouseOf", "ADD", pair(staged.family).join(pair(stored.family), ["tree_id", "x", "y"], "left_anti")))
    new, old = _blank(staged.event, stored.place), _blank(stored.event, stored.place)
    on = ["tree_id", "person_id", *EVENT_ATTRIBUTES]
    keyless = old.filter("event_key is null")
    both = lambda s, t, keys: s.select(*keys, F.col("place_id").alias("p1")).join(t.select(*keys, F.col("place_id").alias("p2")), keys)
    same, other = F.col("p1") == F.col("p2"), F.col("p1") != F.col("p2")
    update = [
        both(new.filter("event_type = 'MARR' and is_derived"), keyless.filter("event_type = 'MARR' and not is_derived and family_id = ''"), on).filter(same),
        both(new.filter("event_type = 'CHR'"), keyless.filter("event_type = 'BIRT' and not is_derived"), on).filter(same),
        both(new.filter("event_type = 'DEAT'"), keyless.filter("event_type = 'DEAT'"), [*on, "is_derived"]).filter(other),
    ]
    out.append(_count("Event", "UPDATE", reduce(DataFrame.unionByName, [u.select("person_id") for u in update])))
    known = reduce(DataFrame.unionByName, _matches(new, old, True, "place_id"))
    out.append(_count("Event", "ADD", new.join(known, "row_id", "left_anti")))
    kept = reduce(DataFrame.unionByName, _matches(old, new, False, "place_text"))
    out.append(_count("Event", "MISSING_FROM_IMPORT", old.join(kept, "row_id", "left_anti")))
    cited = staged.citation.join(stored.event.filter("event_key is not null").select("tree_id", "person_id", "event_key").distinct().withColumn("known", F.lit(True)), ["tree_id", "person_id", "event_key"], "left")
    out.append(cited.groupBy(F.when(F.col("known"), "REPLACE").otherwise("ADD").alias("change")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("EventCitation").alias("entity"), "change", "rows"))
    return reduce(DataFrame.unionByName, out).filter("rows > 0")


def preview_samples(stored: Snapshot, staged: Snapshot, limit: int = 200) -> DataFrame:
    """Up to ``limit`` added or changed persons with old and new values, per tree."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    a = stored.person.select("tree_id", "person_id", F.col("display_name").alias("old_name"), *[F.col(c).alias(f"_old_{c}") for c in PERSON_COLUMNS], F.lit(True).alias("known"))
    rows = staged.person.join(a, ["tree_id", "person_id"], "left")
    differ = [text(c) != text(f"_old_{c}") for c in PERSON_COLUMNS if c != "is_living"] + [F.coalesce("is_living", F.lit(False)) != F.coalesce("_old_is_living", F.lit(False))]
    change = F.when(F.col("known").isNull(), "ADD").when(reduce(lambda x, y: x | y, differ), "UPDATE")
    order = W.partitionBy("tree_id").orderBy("change", F.asc_nulls_last("display_name"), "person_id")
    return rows.withColumn("change", change).filter("change is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("tree_id", "rank", "change", "person_id", "display_name", "old_name")


@dataclass(frozen=True)
class Scoring:
    least: float = 0.75
    high: float = 0.90


#: Fixed value: least confidence of a parsed name that takes part in scoring.
PARSED_WELL = 0.75


def _dec(x: float) -> Column:
    return F.lit(f"{x:.4f}").cast("decimal(6,4)")


def duplicate_life(snapshot: Snapshot, staged: bool) -> DataFrame:
    """Per name what scoring compares: names, sex, least birth year and place, number of parents.

    Of a staged side only names count that were parsed well and are not blank, of the stored side all.
    """
    e = snapshot.event.filter(F.col("event_type").isin("BIRT", "CHR"))
    life = e.groupBy("tree_id", "person_id").agg(F.min(F.coalesce("year_from", "year_to")).alias("birth_year"), F.min("place_normalized").alias("birth_place"))
    covered = snapshot.parent.groupBy("tree_id", F.col("child_id").alias("person_id")).agg(F.countDistinct("parent_id").alias("parents"))
    names = snapshot.name
    if staged and snapshot.parsed is not None:
        names = snapshot.parsed.filter((F.col("parser_status") == "OK") & (F.col("confidence") >= PARSED_WELL))
    if staged:
        names = names.filter("full_name_normalized <> ''")
    names = names.select("tree_id", "person_id", F.col("full_name_normalized").alias("full"), F.col("given").alias("g"), F.col("surname").alias("s")).distinct()
    joined = names.join(snapshot.person.select("tree_id", "person_id", "sex"), ["tree_id", "person_id"]).join(life, ["tree_id", "person_id"], "left").join(covered, ["tree_id", "person_id"], "left")
    return joined.withColumn("parents", F.coalesce("parents", F.lit(0)))


def sourced_dates(snapshot: Snapshot) -> DataFrame:
    """Cited births, christenings and deaths by their range of dates or, without one, their text: one row for each."""
    cited = snapshot.citation.select("tree_id", "person_id", "event_key").distinct()
    e = snapshot.event.filter(F.col("event_type").isin("BIRT", "CHR", "DEAT") & ~F.col("is_derived") & (F.trim(F.coalesce("date_raw", F.lit(""))) != "")).join(cited, ["tree_id", "person_id", "event_key"], "left_semi")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    known = F.when(F.col("date_from").isNotNull() | F.col("date_to").isNotNull(), F.concat(text("date_from"), F.lit("|"), text("date_to")))
    return e.groupBy("tree_id", "person_id", "event_type", known.alias("range"), F.lower(F.trim("date_raw")).alias("raw")).agg(F.min("date_raw").alias("date_raw"))


def sourced_evidence(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Per pair (tree_id, id1, id2) with cited dates of one type on both sides: agree, conflict and a text for either.

    Each cited date of one person meets each of the other: two ranges agree or conflict, two
    texts without ranges do; equal texts agree in any case.
    """
    x = left.select("tree_id", F.col("person_id").alias("id1"), "event_type", F.col("range").alias("k1"), F.col("raw").alias("t1"), F.col("date_raw").alias("d1"))
    y = right.select("tree_id", F.col("person_id").alias("id2"), "event_type", F.col("range").alias("k2"), F.col("raw").alias("t2"), F.col("date_raw").alias("d2"))
    both = pairs.select("tree_id", "id1", "id2").distinct().join(x, ["tree_id", "id1"]).join(y, ["tree_id", "id2", "event_type"])
    ranges, open_ = F.col("k1").isNotNull() & F.col("k2").isNotNull(), F.col("k1").isNull() & F.col("k2").isNull()
    conflict = (ranges & (F.col("k1") != F.col("k2"))) | (open_ & (F.col("t1") != F.col("t2")))
    same_range, same_text = ranges & (F.col("k1") == F.col("k2")), F.col("t1") == F.col("t2")
    say = lambda *parts: F.concat(F.lit("source-backed "), F.col("event_type"), *parts)
    against = F.when(conflict, say(F.lit(" dates differ: "), F.col("d1"), F.lit(" vs "), F.col("d2")))
    pro = F.when(same_range, say(F.lit(" date range matches: "), F.col("d1"))).when(same_text, say(F.lit(" date matches exactly: "), F.col("d1")))
    return both.groupBy("tree_id", "id1", "id2").agg(
        F.max((same_range | same_text).cast("int")).alias("agree"), F.max(conflict.cast("int")).alias("conflict"), F.min(pro).alias("agree_text"), F.min(against).alias("conflict_text")
    )


def _scored(pairs: DataFrame, within: bool) -> DataFrame:
    apart = F.abs(F.col("birth_year") - F.col("birth_year2"))
    same_place = F.col("birth_place") == F.col("birth_place2")
    name = F.when(F.col("full") == F.col("full2"), _dec(1)).otherwise(_dec(0.82))
    date = F.when(apart.isNull(), _dec(0.5)).when(apart <= 1, _dec(1)).when(apart <= 5, _dec(0.75)).otherwise(_dec(0))
    place = F.when(same_place.isNull(), _dec(0.5)).when(same_place, _dec(1)).otherwise(_dec(0.25))
    against = F.when(F.col("sex") != F.col("sex2"), _dec(0.35)).otherwise(_dec(0)) + F.when(apart > 10, _dec(0.35)).otherwise(_dec(0)) + F.when(F.col("conflict") == 1, _dec(1)).otherwise(_dec(0))
    versus = lambda text, a, b: F.concat(F.lit(text), F.col(a).cast("string"), F.lit(" vs "), F.col(b).cast("string"))
    # fixed values: the wording of the evidence
    alike = "same normalized given/surname: " if within else "same given/surname: "
    orphans = ("left person has no staged parents", "right person has no staged parents") if within else ("staged person has no staged parents", "existing person has no tree parents")
    evidence = F.concat_ws(
        "; ", F.when(F.col("full") == F.col("full2"), F.concat(F.lit("exact normalized full name: "), "full")),
        F.when(F.col("full") != F.col("full2"), F.concat(F.lit(alike), F.coalesce("g", F.lit("")), F.lit(" "), F.coalesce("s", F.lit("")))),
        F.when(apart <= 5, versus("birth years compatible: ", "birth_year", "birth_year2")), F.when(same_place, F.concat(F.lit("birth place matches: "), "birth_place")),
        F.when(F.col("parents") == 0, orphans[0]), F.when(F.col("parents2") == 0, orphans[1]), "agree_text",
    )
    against_text = F.concat_ws(
        "; ", F.when(F.col("sex") != F.col("sex2"), versus("sex differs: ", "sex", "sex2")), F.when(apart > 10, versus("birth years differ: ", "birth_year", "birth_year2")),
        F.when(~same_place, versus("birth places differ: ", "birth_place", "birth_place2")), "conflict_text",
    )
    df = pairs.withColumns({
        "name_score": name, "date_score": date, "place_score": place, "family_score": _dec(0), "event_score": F.when(F.col("agree") == 1, _dec(1)).otherwise(_dec(0)),
        "negative_score": against.cast("decimal(6,4)"), "evidence_for": F.nullif(evidence, F.lit("")), "evidence_against": F.nullif(against_text, F.lit("")),
    })
    total = F.lit("0.75").cast("decimal(3,2)") * F.col("name_score") + F.lit("0.15").cast("decimal(3,2)") * F.col("date_score") + F.lit("0.10").cast("decimal(3,2)") * F.col("place_score") - F.col("negative_score")
    return df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(1), total)).cast("decimal(6,4)"))


def duplicates(staged: Snapshot, stored: Snapshot | None = None, scoring: Scoring = Scoring()) -> DataFrame:
    """Scored duplicate candidates within an import, or of an import against the stored tree.

    Names match in full, or in given name and surname; at least one side has no parents;
    cited dates that conflict weigh against, on either side.  One row per pair, the best of its names.
    """
    within = stored is None
    a = duplicate_life(staged, True).withColumnRenamed("person_id", "id1")
    b = duplicate_life(staged if within else stored, within)
    b = b.toDF(*[c if c == "tree_id" else ("id2" if c == "person_id" else f"{c}2") for c in b.columns]).withColumnRenamed("tree_id", "tree_id2")
    strong = a.filter("g <> '' and s <> ''")
    apart = (F.col("id1") < F.col("id2")) if within else (F.col("id1") != F.col("id2"))
    keys = ["tree_id", "id1", "id2", "full", "full2", "g", "s", "g2", "s2"]
    pairs = or_equi_join(a, b, [[("tree_id", "tree_id2"), ("full", "full2")]], keys)
    more = or_equi_join(strong, b, [[("tree_id", "tree_id2"), ("g", "g2"), ("s", "s2")]], keys)
    pairs = pairs.unionByName(more).dropDuplicates(keys).filter(apart & ((F.col("parents") == 0) | (F.col("parents2") == 0)))
    cited = sourced_dates(staged)
    pairs = pairs.join(sourced_evidence(pairs, cited, cited if within else sourced_dates(stored)), ["tree_id", "id1", "id2"], "left")
    best = F.row_number().over(W.partitionBy("tree_id", "id1", "id2").orderBy(F.desc("score"), F.desc("name_score"), F.desc("date_score"), F.desc("place_score"), "full", "full2", "g", "s", "g2", "s2"))
    action = F.when(F.col("score") >= scoring.high, "review_high_confidence").otherwise("review")
    rows = _scored(pairs, within).filter(F.col("score") >= _dec(scoring.least)).withColumn("rn", best).filter("rn = 1")
    return rows.select(
        "tree_id", "id1", "id2", "score", "name_score", "date_score", "place_score", "family_score", "event_score", "negative_score", "evidence_for", "evidence_against", action.alias("recommended_action")
    )


#: What identifies a proposal: batch, scope, the first imported person, and the second or the existing one.
IDENTITY = ["import_batch_id", "candidate_scope", "import_tree_person_id1", "import_tree_person_id2", "existing_tree_person_id"]


def suppress_rejected(candidates: DataFrame, decided: DataFrame) -> DataFrame:
    """Candidates whose identity was not rejected before; ids in either letter case, null being a value except for the first person."""
    key = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    names = [f"_k{n}" for n in range(len(IDENTITY))]
    rejected = decided.filter("status = 'rejected' and import_tree_person_id1 is not null").select(*[key(c).alias(n) for c, n in zip(IDENTITY, names)]).distinct()
    return candidates.withColumns({n: key(c) for c, n in zip(IDENTITY, names)}).join(rejected, names, "left_anti").drop(*names)


def regenerate(decided: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored candidates after new ones were found for the batches of ``fresh``.

    Open and stale rows of these batches go, decided ones stay, and what was rejected is not proposed again.
    """
    batches = fresh.select("import_batch_id").distinct().withColumn("_again", F.lit(True))
    kept = decided.join(batches, "import_batch_id", "left").filter("_again is null or status not in ('suggested', 'stale')").drop("_again")
    return kept.unionByName(suppress_rejected(fresh, decided).withColumn("status", F.lit("suggested")), allowMissingColumns=True)


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """Per scope: candidates, those of high and of medium confidence, greatest score; each stored candidate once."""
    once = candidates.dropDuplicates(["duplicate_candidate_id"])
    return once.groupBy("candidate_scope").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum(F.when(F.col("score") >= 0.9, 1).otherwise(0)).alias("high"),
        F.sum(F.when((F.col("score") >= 0.75) & (F.col("score") < 0.9), 1).otherwise(0)).alias("medium"), F.max("score").alias("max_score"),
    )


def candidate_list(candidates: DataFrame, limit: int = 100) -> DataFrame:
    """Per batch the ``limit`` best candidates that are open, best first."""
    order = W.partitionBy("import_batch_id").orderBy(F.desc("score"), "duplicate_candidate_id")
    once = candidates.filter("status = 'suggested'").dropDuplicates(["duplicate_candidate_id"])
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, min(500, limit))).select("import_batch_id", "rank", "duplicate_candidate_id", "candidate_scope", "import_person1_name", "import_person2_name", "existing_person_name", "score")


def candidate_events(candidates: DataFrame) -> DataFrame:
    """The events of both sides of each candidate, as one row each."""
    once = candidates.dropDuplicates(["duplicate_candidate_id"])
    return once.select("duplicate_candidate_id", F.posexplode("events").alias("position", "e")).select("duplicate_candidate_id", "position", "e.*").filter(F.col("event_type").isin("BIRT", "CHR", "DEAT", "MARR"))


def candidate_relatives(candidates: DataFrame, parent: DataFrame, family: DataFrame, person: DataFrame, column: str, side: str) -> DataFrame:
    """(duplicate_candidate_id, side, relation, relative_id, name): parents, children and spouses of one person of each candidate.

    ``column`` names the candidate's person, ``parent``, ``family`` and ``person`` are the side
    that it belongs to.  A candidate without that person, or one without relatives, has no rows.
    """
    once = candidates.select("duplicate_candidate_id", F.lower(F.trim(column)).alias("person_id")).filter("person_id is not null").distinct()
    kin = [
        parent.select("tree_id", F.col("child_id").alias("person_id"), F.lit("parent").alias("relation"), F.col("parent_id").alias("relative_id")),
        parent.select("tree_id", F.col("parent_id").alias("person_id"), F.lit("child").alias("relation"), F.col("child_id").alias("relative_id")),
        family.select("tree_id", F.col("spouse1_id").alias("person_id"), F.lit("spouse").alias("relation"), F.col("spouse2_id").alias("relative_id")),
        family.select("tree_id", F.col("spouse2_id").alias("person_id"), F.lit("spouse").alias("relation"), F.col("spouse1_id").alias("relative_id")),
    ]
    names = person.select("tree_id", F.col("person_id").alias("relative_id"), F.col("display_name").alias("name"))
    rows = once.join(reduce(DataFrame.unionByName, kin), "person_id").join(names, ["tree_id", "relative_id"])
    return rows.select("duplicate_candidate_id", F.lit(side).alias("side"), "relation", "relative_id", "name").distinct()


def readiness(batches: DataFrame, candidates: DataFrame, names: DataFrame | None = None, warnings: DataFrame | None = None, high: float = 0.90) -> DataFrame:
    """The gates of every batch (four with all inputs), with severity ``pass`` where nothing is amiss.

    Open high-confidence duplicates block; names that were not parsed well (``names``:
    import_batch_id, parser_status), date warnings (``warnings``: import_batch_id) and persons
    out of scope warn.  A gate whose input is not given can't be judged and is left out, not passed.
    """
    per = lambda df: df.groupBy("import_batch_id").agg(F.count(F.lit(1)).alias("n"))
    open_high = per(candidates.filter((F.col("status") == "suggested") & (F.col("score") >= high)).dropDuplicates(["duplicate_candidate_id"]))
    gates = [("high_confidence_duplicates", "blocker", open_high)]
    if names is not None:
        gates.append(("name_parsing_issues", "warning", per(names.filter("parser_status <> 'OK'"))))
    if warnings is not None:
        gates.append(("date_warnings", "warning", per(warnings)))
    gates.append(("scope_invalid", "warning", batches.select("import_batch_id", F.col("scope_invalid_count").cast("bigint").alias("n"))))
    counts = reduce(DataFrame.unionByName, [df.select("import_batch_id", F.lit(gate).alias("gate"), "n") for gate, _, df in gates])
    wanted = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.lit(s).alias("bad")) for g, s, _ in gates])).alias("x")
    rows = batches.select("import_batch_id", wanted).select("import_batch_id", "x.*").join(counts, ["import_batch_id", "gate"], "left").withColumn("issues", F.coalesce("n", F.lit(0)).cast("bigint"))
    return rows.select("import_batch_id", "gate", F.when(F.col("issues") > 0, F.col("bad")).otherwise("pass").alias("severity"), "issues", (F.col("issues") == 0).alias("passed"))


def readiness_report(batches: DataFrame, candidates: DataFrame, names: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """Per batch: whether it may be applied without review, that it must be confirmed, open duplicates, and its state after the report.

    A batch that waits for nothing else than its confirmation becomes WAITING_FOR_CONFIRMATION; decided ones keep their state.
    """
    gates = readiness(batches, candidates, names, warnings).groupBy("import_batch_id").agg(
        (F.sum(F.when(F.col("severity") == "blocker", F.col("issues")).otherwise(0)) == 0).alias("can_apply_without_review"), F.sum(F.when(F.col("severity") != "pass", 1).otherwise(0)).alias("failed_gates")
    )
    open_ = candidates.filter("status = 'suggested'").dropDuplicates(["duplicate_candidate_id"]).groupBy("import_batch_id").agg(F.count(F.lit(1)).alias("duplicates"))
    rows = batches.select("import_batch_id", "status").join(gates, "import_batch_id").join(open_, "import_batch_id", "left")
    status = F.when(F.col("status").isin("STAGED", "PREVIEWED"), "WAITING_FOR_CONFIRMATION").otherwise(F.col("status"))
    return rows.select("import_batch_id", "can_apply_without_review", F.lit(True).alias("requires_explicit_confirmation"), "failed_gates", F.coalesce("duplicates", F.lit(0)).cast("bigint").alias("duplicates"), status.alias("status"))


def pending(batches: DataFrame, candidates: DataFrame, limit: int = 50) -> DataFrame:
    """Batches that wait, newest first, with their open candidates."""
    waiting = batches.filter(F.col("status").isin("STAGED", "PREVIEWED", "WAITING_FOR_CONFIRMATION"))
    counts = candidates.filter("status = 'suggested'").dropDuplicates(["duplicate_candidate_id"]).groupBy("import_batch_id").agg(F.count(F.lit(1)).alias("open_candidates"))
    top = waiting.orderBy(F.desc("created_at"), "import_batch_id").limit(max(1, min(500, limit)))
    return top.join(counts, "import_batch_id", "left").select("import_batch_id", "tree_name", "status", "person_count", F.coalesce("open_candidates", F.lit(0)).cast("bigint").alias("open_candidates"))


def cancel(batches: DataFrame, batch_ids: DataFrame, reason: str) -> DataFrame:
    """Batches with the named ones cancelled, unless they are applied; cancelling twice changes nothing."""
    hit = batches.join(batch_ids.select("import_batch_id").distinct().withColumn("hit", F.lit(True)), "import_batch_id", "left")
    now = F.col("hit").isNotNull() & ~F.col("status").isin("APPLIED", "CANCELLED")
    return hit.withColumns({"notes": F.when(now, F.concat_ws("\n", "notes", F.lit(reason))).otherwise(F.col("notes")), "status": F.when(now, "CANCELLED").otherwise(F.col("status"))}).drop("hit")


class Refused(ValueError):
    """An import that must not be applied as asked."""


def _missing(stored: Snapshot, staged: Snapshot) -> tuple[DataFrame, DataFrame]:
    """Stored persons that the import of their tree lacks, and families that it lacks or that lose a spouse."""
    trees = staged.person.select("tree_id").distinct()
    person = stored.person.join(trees, "tree_id", "left_semi").join(staged.person, ["tree_id", "person_id"], "left_anti").select("tree_id", "person_id")
    own = stored.family.join(trees, "tree_id", "left_semi")
    lone = own.join(staged.family, ["tree_id", "family_id"], "left_anti").select("tree_id", "family_id")
    parted = [own.join(person.withColumnRenamed("person_id", c), ["tree_id", c], "left_semi").select("tree_id", "family_id") for c in ("spouse1_id", "spouse2_id")]
    return person, reduce(DataFrame.unionByName, [lone, *parted]).distinct()


def _without_missing(stored: Snapshot, staged: Snapshot) -> tuple[Snapshot, list[DataFrame]]:
    """The stored side without what the import lacks and all that refers to it, and the numbers of what went."""
    person, family = _missing(stored, staged)
    counts = []

    def cut(entity: str, df: DataFrame, *by: tuple[DataFrame, str, str]) -> DataFrame:
        """Rows of ``df`` whose ``column`` names nothing that is gone; null names nothing."""
        kept = df
        for gone, key, column in by:
            kept = kept.join(gone.select("tree_id", F.col(key).alias(column)), ["tree_id", column], "left_anti")
        both = df.agg(F.count(F.lit(1)).alias("n")).unionByName(kept.agg((-F.count(F.lit(1))).alias("n")))
        counts.append(both.agg(F.sum("n").alias("rows")).select(F.lit(entity).alias("entity"), F.lit("DELETE").alias("change"), "rows"))
        return kept.select(df.columns)

    p = lambda column: (person, "person_id", column)
    f = (family, "family_id", "family_id")
    event = cut("Event", stored.event, p("person_id"), p("related_id"), f)
    children = None if stored.family_child is None else cut("FamilyChild", stored.family_child, f, p("child_id"))
    citation = stored.citation.join(event.select("tree_id", "person_id", "event_key"), ["tree_id", "person_id", "event_key"], "left_semi")
    rest = Snapshot(
        cut("Person", stored.person, p("person_id")), cut("PersonName", stored.name, p("person_id")), cut("ParentOf", stored.parent, p("parent_id"), p("child_id")),
        cut("Family", stored.family, f), event, stored.place, citation, children,
    )
    return rest, counts


def _events(event: DataFrame, staged: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Stored events with those of equal key updated and all others added; an event without key that is stored already is not added again."""
    keys = ["tree_id", "person_id", "event_key"]
    columns = _shared(EVENT_COLUMNS, event, staged)
    carried = [c for c in event.columns if c not in keys and c not in columns]
    raw = {c: f"_raw_{c}" for c in columns if f"_raw_{c}" in staged.columns}
    # several staged events with one key update it as the first of them
    given = [*columns, *raw.values()]
    first = staged.filter("event_key is not null").groupBy(*keys).agg(F.min(F.struct("row_id", *given)).alias("m")).select(*keys, F.lit(True).alias("_in"), *[F.col(f"m.{c}").alias(f"_new_{c}") for c in given])
    both = event.join(first, keys, "left")
    # a reference that leads nowhere is left as it is where it is stored like that
    new = {c: F.when(F.col(f"_new_{raw[c]}").eqNullSafe(F.col(c)), F.col(c)).otherwise(F.col(f"_new_{c}")) if c in raw else F.col(f"_new_{c}") for c in columns}
    changed = F.col("_in").isNotNull() & reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(new[c]) for c in columns])
    marked = both.withColumn("_changed", changed)
    updated = marked.select(*keys, *[F.when(F.col("_changed"), new[c]).otherwise(F.col(c)).alias(c) for c in columns], *carried)
    keyed = staged.filter("event_key is not null").join(event.select(*keys), keys, "left_anti")
    # an event without key is new unless one without key says the same
    keyless, theirs = staged.filter("event_key is null"), event.filter("event_key is null").select("tree_id", "person_id", *columns)
    for names in ([*columns], [raw.get(c, c) for c in columns]):
        x, y = keyless.alias("x"), theirs.alias("y")
        equal = [F.col("x.tree_id") == F.col("y.tree_id"), F.col("x.person_id") == F.col("y.person_id"), *[F.col(f"x.{n}").eqNullSafe(F.col(f"y.{c}")) for n, c in zip(names, columns)]]
        keyless = x.join(y, reduce(lambda i, j: i & j, equal), "left_anti")
    fresh = keyed.unionByName(keyless)
    added = fresh.select(*keys, *columns, *[F.col(c) if c in staged.columns else F.lit(None).cast(event.schema[c].dataType).alias(c) for c in carried])
    return updated.unionByName(added).select(event.columns), [_count("Event", "UPDATE", marked.filter("_changed")), _count("Event", "ADD", added)]


def apply_import(stored: Snapshot, staged: Snapshot, delete_missing: bool = False) -> tuple[Snapshot, DataFrame]:
    """The snapshot after an import, and the (entity, change, rows) it made.

    Persons, families and keyed events are updated or added, names, places, children and
    parent edges only added; the cited sources of staged events replace those of an earlier
    import.  New references to persons and families that neither side knows become null, and
    rows that cannot be without them are left out.  With ``delete_missing`` persons
    and families that the import lacks go first, with all that refers to them, in the trees
    that it covers.  All columns of the stored side are kept, so the result can be applied to.
    """
    p, counts = ["tree_id", "person_id"], []
    if delete_missing:
        stored, counts = _without_missing(stored, staged)
    person, made = merge_snapshot(stored.person, staged.person, p, _shared(PERSON_COLUMNS, stored.person, staged.person))
    counts.append(made.select(F.lit("Person").alias("entity"), "change", "rows"))
    known = person.select(*p)
    exists = lambda df, c: df.join(known.withColumnRenamed("person_id", c), ["tree_id", c], "left_semi").select(df.columns)
    new_place = staged.place.select("place_raw").filter("place_raw is not null").distinct().join(stored.place.select("place_raw"), "place_raw", "left_anti")
    counts.append(_count("Place", "ADD", new_place))
    top = stored.place.agg(F.max("place_id")).first()[0] or 0
    # surrogate numbers need not be consecutive: a hash above the greatest one, stable over retries of a task
    numbered = new_place.select((F.lit(top) + 1 + F.pmod(F.xxhash64("place_raw"), F.lit(1 << 60))).alias("place_id"), "place_raw")
    place = stored.place.unionByName(numbered, allowMissingColumns=True)
    named = stored.name.filter("is_primary").select(*p).distinct().withColumn("_has", F.lit(True)) if "is_primary" in stored.name.columns else None
    names = exists(staged.name, "person_id")
    if named is not None and "is_primary" in names.columns:
        names = names.join(named, p, "left").withColumn("is_primary", F.col("is_primary") & F.col("_has").isNull()).drop("_has")
    name, added = insert_missing(stored.name, names, [*p, "script_code", "full_name_normalized"])
    counts.append(_count("PersonName", "ADD", added))
    whole = exists(exists(staged.family, "spouse1_id"), "spouse2_id")
    family, made = merge_snapshot(stored.family, whole, ["tree_id", "family_id"], _shared(FAMILY_COLUMNS, stored.family, staged.family))
    counts.append(made.select(F.lit("Family").alias("entity"), "change", "rows"))
    children = stored.family_child
    if children is not None and staged.family_child is not None:
        theirs = exists(staged.family_child, "child_id").join(family.select("tree_id", "family_id"), ["tree_id", "family_id"], "left_semi")
        children, added = insert_missing(children, theirs, ["tree_id", "family_id", "child_id"])
        counts.append(_count("FamilyChild", "ADD", added))
    parent, added = insert_missing(stored.parent, exists(exists(staged.parent, "parent_id"), "child_id"), _edge_keys(stored, staged))
    counts.append(_count("ParentOf", "ADD", added))
    events = exists(staged.event, "person_id")
    for table, key, column in ((known, "person_id", "related_id"), (family, "family_id", "family_id")):
        target = table.select("tree_id", F.col(key).alias(column)).distinct().withColumn("_known", F.lit(True))
        events = events.join(target, ["tree_id", column], "left").withColumn(f"_raw_{column}", F.col(column)).withColumn(column, F.when(F.col("_known"), F.col(column))).drop("_known")
    event, made = _events(stored.event, events)
    counts += made
    e = [*p, "event_key"]
    again = events.select(*e).filter("event_key is not null").distinct()
    fresh = staged.citation.join(event.select(*e).distinct(), e, "left_semi").withColumn("source_origin", F.lit(GEDCOM))
    old = stored.citation.join(again.withColumn("_again", F.lit(True)), e, "left").filter((F.col("_again").isNull()) | (F.coalesce("source_origin", F.lit("")) != GEDCOM)).drop("_again")
    counts.append(_count("EventCitation", "REPLACE", fresh))
    citation = old.unionByName(fresh, allowMissingColumns=True).select(stored.citation.columns)
    result = Snapshot(person, name, parent, family, event, place, citation, children)
    return result, reduce(DataFrame.unionByName, counts).filter("rows > 0")


#: Fixed value: the origin of citations that imports own.
GEDCOM = "GEDCOM"


@dataclass(frozen=True)
class Applied:
    snapshot: Snapshot
    changes: DataFrame
    trees: DataFrame
    batches: DataFrame


def apply_batch(stored: Snapshot, staged: Snapshot, batches: DataFrame, trees: DataFrame, batch_id: str, delete_missing: bool = False) -> Applied:
    """Applies the batch of one tree if it exists and waits, and marks it APPLIED; the tree's root becomes the batch's if that person exists.

    Deleting what is missing is refused where the batch's root person is missing itself.
    ``trees``: tree_id, root_person_id.  A root that is deleted becomes null.
    """
    own = batches.filter(F.col("import_batch_id") == batch_id).limit(1).collect()
    if not own:
        raise Refused(f"no import batch {batch_id!r}")
    tree, root, status = own[0]["tree_id"], own[0]["root_person_id"], own[0]["status"]
    if status not in APPLYABLE:
        raise Refused(f"import batch {batch_id!r} is {status}")
    if delete_missing and root is not None and staged.person.filter((F.col("tree_id") == tree) & (F.col("person_id") == root)).isEmpty():
        raise Refused(f"root person {root!r} is missing from the import")
    snapshot, changes = apply_import(stored, staged, delete_missing)
    alive = snapshot.person.select("tree_id", F.col("person_id").alias("root_person_id"), F.lit(True).alias("_alive"))
    kept = trees.join(alive, ["tree_id", "root_person_id"], "left").withColumn("root_person_id", F.when(F.col("_alive") | (F.col("tree_id") != tree), F.col("root_person_id"))).drop("_alive")
    if root is not None and not snapshot.person.filter((F.col("tree_id") == tree) & (F.col("person_id") == root)).isEmpty():
        kept = kept.withColumn("root_person_id", F.when(F.col("tree_id") == tree, F.lit(root)).otherwise(F.col("root_person_id")))
    done = batches.withColumn("status", F.when(F.col("import_batch_id") == batch_id, "APPLIED").otherwise(F.col("status")))
    if "applied_at" in done.columns:
        done = done.withColumn("applied_at", F.when(F.col("import_batch_id") == batch_id, F.current_timestamp().cast(done.schema["applied_at"].dataType)).otherwise(F.col("applied_at")))
    return Applied(snapshot, changes, kept.select(trees.columns), done)
