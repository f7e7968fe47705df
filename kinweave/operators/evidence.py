"""Evidence: record search, link suggestions and content-addressed attachments."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions.ids import attachment_type, content_hash, mime_type


@dataclass(frozen=True)
class Facets:
    """What a record search asks for; a facet that is None adds no predicate to the plan."""

    status: str | None = None
    record_type: str | None = None
    free_text: str | None = None
    surname: str | None = None
    given_name: str | None = None
    place: str | None = None
    archive_prefix: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    keyword: str | None = None
    role: str | None = None
    linked: bool | None = None
    tree_id: str | None = None
    archive_name: str | None = None
    fond: str | None = None
    opis: str | None = None
    sprava: str | None = None
    page: str | None = None
    top: int = 50


#: Parts of an archive reference that records may name apart.
ARCHIVE = ["archive_name", "fond", "opis", "sprava", "page"]


def _has(c: Column, text: str) -> Column:
    return F.lower(c).contains(text.strip().lower())


def _any_has(df: DataFrame, columns: list[str], text: str) -> Column:
    """Whether any of the columns that the table has contains the text."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(_has(F.col(c), text), F.lit(False)) for c in columns if c in df.columns], F.lit(False)), F.lit(False))


def search_records(records: DataFrame, person_mentions: DataFrame, place_mentions: DataFrame, facets: Facets, keywords: DataFrame | None = None) -> DataFrame:
    """Records that meet all facets, newest first, up to ``top``, each with the total number.

    records: source_record_id, record_type, text, archive_ref, year_from, year_to, created_at,
    and as far as known tree_id, title, transcription, place_text, church_text and the parts of
    ARCHIVE; a facet on a column that the table lacks is an error.  Free text looks into title,
    text and transcription.  Records without years fail a year facet.  A record's mentions count if any of them fits.
    """
    key = ["source_record_id"]
    df = records
    if facets.status is not None:
        df = df.filter(F.col("status") == facets.status)
    if facets.record_type is not None:
        df = df.filter(F.col("record_type") == facets.record_type)
    if facets.free_text:
        df = df.filter(_any_has(df, ["title", "text", "transcription"], facets.free_text))
    if facets.tree_id is not None:
        df = df.filter(F.lower(F.trim("tree_id")) == facets.tree_id.strip().lower())
    for part in ARCHIVE:
        if getattr(facets, part):
            df = df.filter(_has(F.col(part), getattr(facets, part)))
    if facets.archive_prefix:
        df = df.filter(F.lower("archive_ref").startswith(facets.archive_prefix.strip().lower()))
    if facets.year_from is not None:
        df = df.filter(F.col("year_to") >= facets.year_from)
    if facets.year_to is not None:
        df = df.filter(F.col("year_from") <= facets.year_to)
    for column, text in (("surname", facets.surname), ("given_name", facets.given_name)):
        if text:
            df = df.join(person_mentions.filter(_has(F.col(column), text)).select(*key), key, "left_semi")
    if facets.place:
        named = place_mentions.filter(_has(F.col("place_text"), facets.place) | _has(F.col("normalized_name"), facets.place)).select(*key).distinct().withColumn("_named", F.lit(True))
        own = _any_has(df, ["place_text", "church_text"], facets.place)
        df = df.join(named, key, "left").filter(F.col("_named").isNotNull() | own).drop("_named")
    if facets.role is not None:
        df = df.join(person_mentions.filter(F.col("role") == facets.role).select(*key), key, "left_semi")
    if facets.keyword and keywords is not None:
        df = df.join(keywords.filter(_has(F.col("keyword"), facets.keyword)).select(*key), key, "left_semi")
    if facets.linked is not None:
        df = df.join(person_mentions.filter("status = 'accepted'").select(*key), key, "left_semi" if facets.linked else "left_anti")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    page = df.orderBy(F.desc("created_at"), "source_record_id").limit(max(1, min(500, facets.top)))
    # the total is one row, attached to a page of at most 500
    return page.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")


def text_score(a: Column, b: Column, exact: str, partial: str) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    dec = lambda v: F.lit(v).cast("decimal(5,4)")
    known = (F.length(x) > 0) & (F.length(y) > 0)
    return F.when(known & (x == y), dec(exact)).when(known & (x.contains(y) | y.contains(x)), dec(partial)).otherwise(dec("0"))


def year_score(a: Column, b: Column) -> Column:
    apart = F.abs(a.cast("int") - b.cast("int"))
    dec = lambda v: F.lit(v).cast("decimal(5,4)")
    return F.when(apart <= 1, dec("0.20")).when(apart <= 3, dec("0.10")).when(apart <= 7, dec("0.05")).otherwise(dec("0"))


#: Birth years further apart than this add nothing to a score.
_YEARS = 7


def _inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(tree, inner, outer): all names of ``inner`` (tree, inner) within names of ``outer`` (tree, outer); both are distinct and not empty.

    The first three letters of the inner name meet all runs of up to three letters of the outer one.
    """

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("outer")), lambda i: F.substring(F.col("outer"), i, F.lit(n)))

    left = inner.withColumn("run", F.substring("inner", 1, 3))
    right = outer.withColumn("run", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))))
    return left.join(right, ["tree", "run"]).filter(F.col("outer").contains(F.col("inner"))).select("tree", "inner", "outer")


def _related(typed: DataFrame, listed: DataFrame, name: str, known: str) -> DataFrame:
    """(tree, name, known, pooled): names of a tree of which one contains the other; ``pooled`` where the listed one contains the typed one."""
    mine, theirs = typed.select("tree", name).dropna().distinct(), listed.select("tree", known).dropna().distinct()
    forth = _inside(mine.withColumnRenamed(name, "inner"), theirs.withColumnRenamed(known, "outer")).select("tree", F.col("inner").alias(name), F.col("outer").alias(known), F.lit(True).alias("pooled"))
    back = _inside(theirs.withColumnRenamed(known, "inner"), mine.withColumnRenamed(name, "outer")).filter("inner <> outer").select("tree", F.col("outer").alias(name), F.col("inner").alias(known), F.lit(False).alias("pooled"))
    return forth.unionByName(back)


def _first(persons: DataFrame, by: list[str], top: int) -> DataFrame:
    """The ``top`` persons with the smallest ids per value of ``by``."""
    return persons.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("person_id"))).filter(F.col("_n") <= top).drop("_n")


def _pool(mentions: DataFrame, persons: DataFrame, related: DataFrame, typed: list[str], known: list[str], top: int) -> DataFrame:
    """Mentions with the persons that ``related`` (tree, typed, known, level) names, as far as they can be among the top.

    Of persons of equal level and equal birth year the first few by id are enough, and so
    they are of persons whose year adds nothing.  A hot name thus gives a bounded number of rows.
    """
    few = _first(persons, ["tree", *known, "b2"], top)
    people = related.join(few, ["tree", *known])
    dated = _first(people.filter("b2 is not null"), ["tree", *typed, "level", "b2"], top)
    years = mentions.filter("y is not null").withColumn("b2", F.explode(F.sequence(F.col("y") - _YEARS, F.col("y") + _YEARS)))
    columns = ["person_mention_id", "s", "g", "y", "person_id", "s2", "g2", "b2"]
    near = years.join(dated, ["tree", *typed, "b2"]).select(*columns)
    return near.unionByName(mentions.join(_first(people, ["tree", *typed, "level"], top), ["tree", *typed]).select(*columns))


def suggest_links(mentions: DataFrame, persons: DataFrame, top: int = 10) -> DataFrame:
    """Per unlinked mention the ``top`` persons of its tree by score: person_mention_id, person_id, score, rank.

    Surname 0.50 / 0.25, given name 0.30 / 0.15, birth year 0.20 / 0.10 / 0.05.  The pool are
    all persons whose surname contains the mention's or whose given name contains the
    mention's.  Distinct names are matched once per tree; persons come in three ways: by
    surname, by given name, and by both, each cut to those that can be among the top.
    """
    top = max(1, min(100, top))
    plain = lambda c: F.when(F.length(F.trim(c)) > 0, F.lower(F.trim(c)))
    tree = F.lower(F.trim("tree_id")).alias("tree")
    m = mentions.select("person_mention_id", tree, plain("surname").alias("s"), plain("given_name").alias("g"), F.col("estimated_birth_year").cast("int").alias("y"))
    p = persons.select(tree, "person_id", plain("surname_normalized").alias("s2"), plain("given_name").alias("g2"), F.col("birth_year").cast("int").alias("b2")).distinct()
    by_surname, by_given = text_score(F.col("s"), F.col("s2"), "0.50", "0.25"), text_score(F.col("g"), F.col("g2"), "0.30", "0.15")
    surnames, given = _related(m, p, "s", "s2"), _related(m, p, "g", "g2")
    named = m.select("tree", "s", "g").dropna().distinct().join(surnames, ["tree", "s"]).join(p.select("tree", "s2", "g2").dropna().distinct(), ["tree", "s2"])
    both = named.filter((by_given > 0) & (F.col("pooled") | F.col("g2").contains(F.col("g"))))
    pool = (
        _pool(m, p, surnames.filter("pooled").withColumn("level", by_surname).drop("pooled"), ["s"], ["s2"], top)
        .unionByName(_pool(m, p, given.filter("pooled").withColumn("level", by_given).drop("pooled"), ["g"], ["g2"], top))
        .unionByName(_pool(m, p, both.withColumn("level", by_surname + by_given).drop("pooled"), ["s", "g"], ["s2", "g2"], top))
    )
    score = F.least(F.lit(1), by_surname + by_given + year_score(F.col("y"), F.col("b2"))).cast("decimal(5,4)")
    scored = pool.groupBy("person_mention_id", "person_id").agg(F.max(score).alias("score")).filter("score > 0")
    rank = F.row_number().over(W.partitionBy("person_mention_id").orderBy(F.desc("score"), "person_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top)


def persist_candidates(suggested: DataFrame, stored: DataFrame) -> DataFrame:
    """What becomes of suggestions given the latest stored decision (mention, person, status, score): status, score, action."""
    latest = stored.select("person_mention_id", "person_id", F.col("status").alias("was"), F.col("score").alias("old_score"))
    both = suggested.join(latest, ["person_mention_id", "person_id"], "left")
    action = F.when(F.col("was").isNull(), "insert").when(F.col("was") == "rejected", "skip").when(F.col("was") == "suggested", "refresh").otherwise("keep")
    return both.withColumn("action", action).select("person_mention_id", "person_id", "action", F.when(F.col("action") == "keep", F.col("old_score")).otherwise(F.col("score")).alias("score"))


def decide_links(candidates: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidate states after decisions: an accepted link supersedes the mention's other open ones."""
    a = accepted.select("person_mention_id", "person_id").distinct().withColumn("acc", F.lit(True))
    r = rejected.select("person_mention_id", "person_id").distinct().withColumn("rej", F.lit(True))
    m = accepted.select("person_mention_id").distinct().withColumn("done", F.lit(True))
    df = candidates.join(a, ["person_mention_id", "person_id"], "left").join(r, ["person_mention_id", "person_id"], "left").join(m, "person_mention_id", "left")
    status = F.when(F.col("acc"), "accepted").when(F.col("rej"), "rejected").when(F.col("done") & (F.col("status") == "suggested"), "superseded").otherwise(F.col("status"))
    return df.withColumn("status", status).drop("acc", "rej", "done")


def accept_on_mentions(mentions: DataFrame, accepted: DataFrame) -> DataFrame:
    """Mentions with the person and the confidence of their accepted link (person_mention_id, person_id, score)."""
    links = accepted.select("person_mention_id", F.col("person_id").alias("_person"), F.col("score").alias("_score")).dropDuplicates(["person_mention_id"])
    df = mentions.join(links, "person_mention_id", "left")
    now = F.col("_person").isNotNull()
    old = lambda c, new: F.col(c) if c in mentions.columns else F.lit(None).cast(accepted.schema[new].dataType)
    values = {
        "status": F.when(now, "accepted").otherwise(F.col("status")), "accepted_person_id": F.when(now, F.col("_person")).otherwise(old("accepted_person_id", "person_id")),
        "link_confidence": F.when(now, F.col("_score")).otherwise(old("link_confidence", "score")),
    }
    return df.withColumns(values).drop("_person", "_score")


def patch_records(records: DataFrame, patch: DataFrame, columns: list[str]) -> DataFrame:
    """Records with the patch's non-null values; null leaves a value as it is."""
    p = patch.select("source_record_id", *[F.col(c).alias(f"_{c}") for c in columns])
    df = records.join(p, "source_record_id", "left")
    return df.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 20 * 1024 * 1024
    record_bytes: int = 100 * 1024 * 1024
    base64_bytes: int = 8 * 1024 * 1024


def decoded_blobs(blobs: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(blobs, rejected) of attachments given as base64 text: source_record_id, base64, sequence_no.

    A text that must decode to more than the limit is rejected before it is decoded; so are
    one that decodes to more and one that is no base64.  Null is an empty blob.
    """
    most = (limits.base64_bytes + 2) // 3 * 4 + 4
    long = F.length("base64") > most
    df = blobs.withColumn("content", F.when(~F.coalesce(long, F.lit(False)), F.try_to_binary(F.coalesce("base64", F.lit("")), F.lit("base64"))))
    reason = F.when(long | (F.length("content") > limits.base64_bytes), "too large").when(F.col("content").isNull(), "no base64")
    df = df.withColumn("reason", reason)
    return df.filter("reason is null").drop("reason", "base64"), df.filter("reason is not null").select("source_record_id", "sequence_no", "reason")


def blobs_of_files(files: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs, rejected) of attachments given by path: ``files`` source_record_id, path, sequence_no; ``contents`` as binaryFile reads it."""
    both = files.join(contents.select("path", "content", F.lit(True).alias("_read")), "path", "left")
    missing = both.filter("_read is null").select("source_record_id", "sequence_no", F.lit("no such file").alias("reason"))
    return both.filter("_read").drop("path", "_read"), missing


def store_attachments(blobs: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contents, links, rejected) of blobs (source_record_id, content, sequence_no).

    Equal bytes are stored once; a record's distinct contents may not exceed its quota, in
    the order of their numbers.  Empty, oversize and unknown types are rejected.
    """
    df = blobs.withColumns({"content_hash": content_hash(F.col("content")), "bytes": F.length("content"), "mime": mime_type(F.col("content"))})
    reason = F.when(F.coalesce(F.col("bytes"), F.lit(0)) == 0, "empty").when(F.col("bytes") > limits.file_bytes, "too large").when(F.col("mime").isNull(), "type not accepted")
    df = df.withColumn("reason", reason)
    good = df.filter("reason is null")
    once = good.groupBy("source_record_id", "content_hash").agg(F.min("sequence_no").alias("sequence_no"), F.first("bytes").alias("bytes"), F.first("mime").alias("mime"))
    used = F.sum("bytes").over(W.partitionBy("source_record_id").orderBy("sequence_no", "content_hash"))
    judged = once.withColumn("used", used)
    links = judged.filter(F.col("used") <= limits.record_bytes).select("source_record_id", "content_hash", "sequence_no", attachment_type(F.col("mime")).alias("attachment_type"))
    contents = good.join(links.select("content_hash").distinct(), "content_hash", "left_semi").groupBy("content_hash").agg(F.first("bytes").alias("bytes"), F.first("mime").alias("mime"))
    over = judged.filter(F.col("used") > limits.record_bytes).select("source_record_id", "content_hash", F.lit("quota").alias("reason"))
    rejected = df.filter("reason is not null").select("source_record_id", "content_hash", "reason").unionByName(over)
    return contents, links, rejected


def orphan_contents(contents: DataFrame, links: DataFrame) -> DataFrame:
    return contents.join(links.select("content_hash"), "content_hash", "left_anti")


def integrity(person: DataFrame, name: DataFrame, event: DataFrame, parent: DataFrame) -> DataFrame:
    """(rule, violations) of the rules that a database would enforce."""
    p = ["tree_id", "person_id"]
    n = lambda df: df.agg(F.count(F.lit(1)).alias("violations"))
    rows = [
        ("name without person of its tree", n(name.join(person, p, "left_anti"))),
        ("event without person of its tree", n(event.join(person, p, "left_anti"))),
        ("external id twice in a tree", n(person.filter("external_id is not null").groupBy("tree_id", "external_id").count().filter("count > 1"))),
        ("several primary names", n(name.filter("is_primary").groupBy(*p).count().filter("count > 1"))),
        ("own parent", n(parent.filter("parent_id = child_id"))),
        ("sex outside the domain", n(person.filter("sex is not null and sex not in ('M', 'F')"))),
    ]
    out = None
    for rule, df in rows:
        part = df.select(F.lit(rule).alias("rule"), "violations")
        out = part if out is None else out.unionByName(part)
    return out
