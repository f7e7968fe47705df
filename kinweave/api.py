"""The public operations by name: reads return DataFrames, writes return the new state of a table.

A ``Library`` holds the tables; nothing is changed in place, so a caller stores what it
wants to keep.  References to persons may be ids or names; an ambiguous name gives an
error with its candidates.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import evidence, graphs, imports, trees
from kinweave.plans.adapters import Workspace
from kinweave.sources import gedcom


class Ambiguous(LookupError):
    """A reference that fits no row or several; ``candidates`` are up to ten rows."""

    def __init__(self, message: str, candidates: list):
        super().__init__(message)
        self.candidates = candidates


@dataclass(frozen=True)
class Library:
    ws: Workspace
    batches: DataFrame
    candidates: DataFrame
    records: DataFrame
    person_mentions: DataFrame
    place_mentions: DataFrame
    keywords: DataFrame
    links: DataFrame


def _tree_id(lib: Library, tree: str | None) -> str:
    rows = trees.resolve_tree(lib.ws, tree).limit(11).collect()
    if len(rows) != 1:
        raise Ambiguous(f"{len(rows)} trees fit {tree!r}", rows)
    return rows[0]["tree_id"]


def _person_id(lib: Library, tree_id: str, person: str) -> str:
    own = lib.ws.person.filter((F.col("tree_id") == tree_id) & (F.col("person_id") == person.strip().lower())).limit(1).collect()
    if own:
        return own[0]["person_id"]
    rows = trees.resolve_person(_only(lib, tree_id), person).orderBy("rank").collect()
    exact = [r for r in rows if r["is_exact"]]
    if len(rows) == 1 or len(exact) == 1:
        return (rows if len(rows) == 1 else exact)[0]["person_id"]
    raise Ambiguous(f"{len(rows)} persons fit {person!r}", rows)


def _only(lib: Library, tree_id: str) -> Workspace:
    """The workspace of one tree; the filter reaches the scans."""
    w = lib.ws
    cut = lambda df: df.filter(F.col("tree_id") == tree_id)
    return Workspace(cut(w.tree), cut(w.person), cut(w.name), cut(w.event), cut(w.parent), cut(w.family), w.place)


def _one(lib: Library, person: str, tree: str | None) -> tuple[Workspace, str]:
    t = _tree_id(lib, tree)
    return _only(lib, t), _person_id(lib, t, person)


def list_tree_datasets(lib: Library) -> DataFrame:
    return trees.person_counts(lib.ws).orderBy("name")


def create_tree_dataset(lib: Library, name: str) -> DataFrame:
    """The trees with one more; a name that is taken in any case is an error."""
    if not lib.ws.tree.filter(F.lower("name") == name.strip().lower()).isEmpty():
        raise ValueError(f"a tree is named {name!r}")
    return lib.ws.tree.unionByName(lib.ws.tree.sparkSession.createDataFrame([(str(uuid.uuid4()), name.strip())], "tree_id string, name string"))


def get_tree_person(lib: Library, person: str, tree: str | None = None) -> DataFrame:
    ws, p = _one(lib, person, tree)
    return ws.person.filter(F.col("person_id") == p)


def find_tree_person(lib: Library, name: str, tree: str | None = None, max_results: int = 20, **facets) -> DataFrame:
    found = trees.find_persons(_only(lib, _tree_id(lib, tree)), name, **facets)
    return found.orderBy(F.asc_nulls_last("display_name"), "person_id").limit(max(1, min(500, max_results)))


def get_person_family_context(lib: Library, person: str, tree: str | None = None) -> dict[str, DataFrame]:
    ws, p = _one(lib, person, tree)
    me = F.col("person_id") == p
    parts = {"parents": trees.rich_parents, "siblings": trees.rich_siblings, "marriages": trees.rich_marriages, "children": trees.rich_children, "events": trees.life_events}
    return {k: f(ws).filter(me) for k, f in parts.items()}


def get_person_life_events(lib: Library, person: str, tree: str | None = None) -> DataFrame:
    ws, p = _one(lib, person, tree)
    return trees.life_events(ws).filter(F.col("person_id") == p).orderBy("position")


def _start(ws: Workspace, person_id: str) -> DataFrame:
    return ws.person.filter(F.col("person_id") == person_id).select("tree_id", F.col("person_id").alias("start_id"))


def get_ancestors(lib: Library, person: str, max_generations: int = 6, tree: str | None = None) -> DataFrame:
    ws, p = _one(lib, person, tree)
    rows = graphs.walk(ws.parent, True, max_generations, _start(ws, p)).select("tree_id", "person_id", "generation").distinct()
    return rows.join(ws.person.select("tree_id", "person_id", "display_name", "sex"), ["tree_id", "person_id"]).join(trees.life_dates(ws), ["tree_id", "person_id"], "left")


def get_descendants(lib: Library, ancestor: str, max_generations: int = 8, tree: str | None = None) -> DataFrame:
    ws, p = _one(lib, ancestor, tree)
    return graphs.walk(ws.parent, False, max_generations, _start(ws, p)).join(ws.person.select("tree_id", "person_id", "display_name"), ["tree_id", "person_id"])


def get_descendants_by_year(lib: Library, ancestor: str, year: int, max_generations: int = 8, tree: str | None = None) -> DataFrame:
    ws, p = _one(lib, ancestor, tree)
    return graphs.descendants_at_year(ws, year, max_generations, _start(ws, p))


def _pair(lib: Library, a: str, b: str, tree: str | None) -> tuple[Workspace, DataFrame]:
    t = _tree_id(lib, tree)
    row = (t, "pair", _person_id(lib, t, a), _person_id(lib, t, b))
    return _only(lib, t), lib.ws.tree.sparkSession.createDataFrame([row], "tree_id string, pair_id string, a_id string, b_id string")


def get_closest_common_ancestor(lib: Library, name1: str, name2: str, max_depth: int = 12, tree: str | None = None) -> DataFrame:
    ws, pair = _pair(lib, name1, name2, tree)
    return graphs.common_ancestors(ws, pair, max_depth)


def get_path_between_persons(lib: Library, person1: str, person2: str, max_depth: int = 20, tree: str | None = None) -> DataFrame:
    ws, pair = _pair(lib, person1, person2, tree)
    return graphs.paths_between(ws, pair, max_depth)


def get_person_tree(lib: Library, person: str, direction: str = "ancestors", max_generations: int = 6, include_root: bool = True, tree: str | None = None) -> DataFrame:
    ws, p = _one(lib, person, tree)
    up = direction.strip().lower() in ("ancestors", "ancestor", "up", "parents")
    return graphs.person_tree(ws, up, max_generations, include_root, _start(ws, p))


def stage_gedcom_import(lib: Library, path: str, tree: str | None = None) -> dict[str, DataFrame]:
    """The relations of interchange files, ready to be stored as a staged batch; ids belong to the tree, or to each file's name without one."""
    tree_id = None if tree is None else _tree_id(lib, tree)
    g = gedcom.parse(gedcom.lines(gedcom.read_text_files(lib.ws.tree.sparkSession, path)))
    return {"individuals": g.individuals, "events": gedcom.staged_events(g, tree_id), "families": gedcom.staged_families(g, tree_id), "labels": gedcom.person_labels(g, tree_id), "spouses": gedcom.spouse_edges(g, tree_id), "date_warnings": gedcom.staged_date_warnings(g, tree_id), "places": gedcom.staged_places(g), "parents": gedcom.parent_edges(g), "citations": g.citations, "unresolved": gedcom.unresolved_references(g)}


def get_gedcom_import_preview(stored: imports.Snapshot, staged: imports.Snapshot) -> dict[str, DataFrame]:
    return {"changes": imports.preview(stored, staged).orderBy("entity", "change"), "samples": imports.preview_samples(stored, staged)}


def list_pending_gedcom_imports(lib: Library, top: int = 50) -> DataFrame:
    return imports.pending(lib.batches, lib.candidates, top)


def cancel_gedcom_import(lib: Library, batch_id: str, reason: str = "") -> DataFrame:
    return imports.cancel(lib.batches, lib.batches.filter(F.col("import_batch_id") == batch_id), reason)


def get_gedcom_import_readiness_report(lib: Library, batch_id: str, names: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """Gates of a batch."""
    return imports.readiness(lib.batches.filter(F.col("import_batch_id") == batch_id), lib.candidates, names, warnings)


def get_gedcom_import_readiness_flags(lib: Library, batch_id: str, names: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """Whether a batch may be applied without review, its open duplicates, and the state that the report leaves it in."""
    return imports.readiness_report(lib.batches.filter(F.col("import_batch_id") == batch_id), lib.candidates, names, warnings)


def find_import_duplicate_candidates(lib: Library, batch_id: str, min_score: float = 0.75, top: int = 100) -> DataFrame:
    return imports.candidate_list(lib.candidates.filter((F.col("import_batch_id") == batch_id) & (F.col("score") >= min_score)), top)


def get_duplicate_candidate_detail(lib: Library, candidate_id: int) -> dict[str, DataFrame]:
    one = lib.candidates.filter(F.col("duplicate_candidate_id") == candidate_id)
    w = lib.ws
    relatives = imports.candidate_relatives(one, w.parent, w.family, w.person, "existing_tree_person_id", "existing")
    return {"candidate": one.dropDuplicates(["duplicate_candidate_id"]).drop("events"), "events": imports.candidate_events(one), "relatives": relatives}


def reject_tree_person_merge_candidate(lib: Library, candidate_id: int) -> DataFrame:
    hit = F.col("duplicate_candidate_id") == candidate_id
    return lib.candidates.withColumn("status", F.when(hit, "rejected").otherwise(F.col("status")))


def apply_gedcom_import(stored: imports.Snapshot, staged: imports.Snapshot, delete_missing: bool = False, dry_run: bool = True) -> tuple[imports.Snapshot, DataFrame]:
    """The snapshot and the changes; a dry run leaves the snapshot as it is."""
    return (stored, imports.preview(stored, staged)) if dry_run else imports.apply_import(stored, staged, delete_missing)


def _append(df: DataFrame, **values) -> DataFrame:
    """``df`` with one more row; columns that are not given are null."""
    row = tuple(values.get(f.name) for f in df.schema)
    return df.unionByName(df.sparkSession.createDataFrame([row], df.schema))


def add_research_record(lib: Library, record_type: str, text: str | None = None, **fields) -> Library:
    values = {"source_record_id": str(uuid.uuid4()), "record_type": record_type, "text": text, "created_at": datetime.now()} | fields
    return replace(lib, records=_append(lib.records, **values))


def get_research_record(lib: Library, source_record_id: str) -> dict[str, DataFrame]:
    own = F.col("source_record_id") == source_record_id
    return {"record": lib.records.filter(own), "persons": lib.person_mentions.filter(own), "places": lib.place_mentions.filter(own), "keywords": lib.keywords.filter(own)}


def update_research_record(lib: Library, source_record_id: str, **fields) -> Library:
    """Fields that are None stay as they are."""
    own = F.col("source_record_id") == source_record_id
    given = {k: v for k, v in fields.items() if v is not None}
    return replace(lib, records=lib.records.withColumns({k: F.when(own, F.lit(v)).otherwise(F.col(k)) for k, v in given.items()})) if given else lib


def search_research_records(lib: Library, facets: evidence.Facets) -> DataFrame:
    return evidence.search_records(lib.records, lib.person_mentions, lib.place_mentions, facets, lib.keywords)


def add_record_person_mention(lib: Library, source_record_id: str, **fields) -> Library:
    """A mention is new, or the one of the same id in this record with its fields changed; its link stays."""
    known = fields.get("person_mention_id")
    if known is not None:
        own = (F.col("person_mention_id") == known) & (F.col("source_record_id") == source_record_id)
        changed = {k: F.when(own, F.lit(v)).otherwise(F.col(k)) for k, v in fields.items() if v is not None and k not in ("person_mention_id", "status")}
        return replace(lib, person_mentions=lib.person_mentions.withColumns(changed))
    return replace(lib, person_mentions=_append(lib.person_mentions, **({"source_record_id": source_record_id, "person_mention_id": str(uuid.uuid4()), "status": "unlinked"} | fields)))


def add_record_place_mention(lib: Library, source_record_id: str, place_text: str, **fields) -> Library:
    return replace(lib, place_mentions=_append(lib.place_mentions, **({"source_record_id": source_record_id, "place_mention_id": str(uuid.uuid4()), "place_text": place_text} | fields)))


def add_research_keyword(lib: Library, source_record_id: str, keyword: str) -> Library:
    """Adding a keyword twice changes nothing."""
    return replace(lib, keywords=_append(lib.keywords, source_record_id=source_record_id, keyword=keyword).dropDuplicates(["source_record_id", "keyword"]))


def suggest_record_person_links(lib: Library, person_mention_id: str, top: int = 10) -> DataFrame:
    persons = lib.ws.person
    suggested = evidence.suggest_links(lib.person_mentions.filter(F.col("person_mention_id") == person_mention_id), persons, top)
    return evidence.persist_candidates(suggested, lib.links)


def accept_record_person_link(lib: Library, person_mention_id: str, person_id: str) -> Library:
    return _decide(lib, person_mention_id, person_id, True)


def reject_record_person_link(lib: Library, person_mention_id: str, person_id: str) -> Library:
    return _decide(lib, person_mention_id, person_id, False)


def _decide(lib: Library, mention: str, person: str, accept: bool) -> Library:
    one = lib.links.filter((F.col("person_mention_id") == mention) & (F.col("person_id") == person))
    none = one.limit(0)
    links = evidence.decide_links(lib.links, one if accept else none, none if accept else one)
    mentions = evidence.accept_on_mentions(lib.person_mentions, one) if accept else lib.person_mentions
    return replace(lib, links=links, person_mentions=mentions)


def add_research_attachment(blobs: DataFrame, limits: evidence.Limits = evidence.Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    return evidence.store_attachments(blobs, limits)


def list_research_attachments(links: DataFrame, source_record_id: str) -> DataFrame:
    return links.filter(F.col("source_record_id") == source_record_id).orderBy("sequence_no", "content_hash")


def get_research_attachment(contents: DataFrame, content_hash: str) -> DataFrame:
    """One blob with its bytes as base64."""
    return contents.filter(F.col("content_hash") == content_hash).withColumn("base64", F.base64("content"))


def delete_research_attachment(links: DataFrame, source_record_id: str, content_hash: str) -> DataFrame:
    """Only the link goes; contents without links are found by ``evidence.orphan_contents``."""
    return links.filter(~((F.col("source_record_id") == source_record_id) & (F.col("content_hash") == content_hash)))
