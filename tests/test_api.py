import pytest

from kinweave import api
from kinweave.operators.evidence import Facets
from kinweave.operators.runtime import table
from kinweave.plans.adapters import workspace

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lib(spark):
    docs = table(spark, D, "documents")
    records = docs.selectExpr("source_record_id", "record_type", "text", "archive_ref", "cast(record_year as int) as year_from", "cast(record_year as int) as year_to", "created_at")
    empty = spark.createDataFrame([], "source_record_id string, keyword string")
    links = spark.createDataFrame([], "person_mention_id string, person_id string, status string, score decimal(5,4)")
    return api.Library(workspace(spark, D), table(spark, D, "gedcom_import_batch"), table(spark, D, "duplicate_candidate"), records, table(spark, D, "record_person_mention"), table(spark, D, "record_place_mention"), empty, links)


def test_tree_tools(lib):
    edge = lib.ws.parent.orderBy("tree_id", "child_id").first()
    tree, child, parent = edge["tree_id"], edge["child_id"], edge["parent_id"]
    assert parent in {r["person_id"] for r in api.get_ancestors(lib, child, tree=tree).collect()}
    assert child in {r["person_id"] for r in api.get_descendants(lib, parent, tree=tree).collect()}
    assert api.get_closest_common_ancestor(lib, child, parent, tree=tree).first()["ancestor_id"] == parent
    assert api.get_path_between_persons(lib, child, parent, tree=tree).first()["steps"] == 1
    assert {r["parent_id"] for r in api.get_person_family_context(lib, child, tree)["parents"].collect()} >= {parent}
    with pytest.raises(api.Ambiguous):
        api.get_tree_person(lib, "no such person at all", tree)
    name = api.list_tree_datasets(lib).first()["name"]
    with pytest.raises(ValueError):
        api.create_tree_dataset(lib, name.upper())
    assert api.create_tree_dataset(lib, "another").count() == lib.ws.tree.count() + 1


def test_evidence_tools(lib):
    more = api.add_research_record(lib, "birth", "a text about Zyxwv")
    found = api.search_research_records(more, Facets(free_text="zyxwv")).collect()
    assert [r["total"] for r in found] == [1]
    key = found[0]["source_record_id"]
    more = api.add_research_keyword(api.add_research_keyword(more, key, "k"), key, "k")
    more = api.add_record_person_mention(more, key, surname="Ko")
    mention = api.get_research_record(more, key)["persons"].first()["person_mention_id"]
    more = api.add_record_person_mention(more, key, person_mention_id=mention, surname="Ka")
    more = api.update_research_record(more, key, record_type="death", text=None)
    got = api.get_research_record(more, key)
    assert got["keywords"].count() == 1 and got["persons"].first()["surname"] == "Ka"
    assert (got["record"].first()["record_type"], got["record"].first()["text"]) == ("death", "a text about Zyxwv")


def test_import_tools(lib):
    batch = lib.candidates.filter("status = 'suggested'").first()
    rows = api.find_import_duplicate_candidates(lib, batch["import_batch_id"], 0.0)
    assert rows.count() > 0
    assert api.get_duplicate_candidate_detail(lib, batch["duplicate_candidate_id"])["candidate"].count() == 1
    assert api.reject_tree_person_merge_candidate(lib, batch["duplicate_candidate_id"]).filter(f"duplicate_candidate_id = {batch['duplicate_candidate_id']} and status <> 'rejected'").isEmpty()
    assert api.get_gedcom_import_readiness_report(lib, batch["import_batch_id"]).count() == 2
