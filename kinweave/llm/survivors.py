"""Best representative of each group of duplicates, by token-level consensus.

The distinct values of a group and field are aligned progressively, the most complete
first: each value's tokens are placed into the columns of the profile built so far by
dynamic programming over sound-like keys.  In each column the tokens vote.  A vote weighs
as much as the value it comes from: by completeness first, then by trust (the existing
record, then the latest row), and any number of lesser votes counts only among equals.
The winners are the consensus, and the existing value closest to it survives, each column
that a value lacks, leaves abbreviated or fills with another token than the consensus
adding to its distance.  Trust decides among values at the same distance.

A group of any size is aligned in chunks of bounded size, whose profiles are aligned with
each other in turn.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.names import skeleton
from kinweave.operators.joins import counted_join
from kinweave.operators.runtime import Scratch

#: Distinct values, or profiles, that are aligned in one go.
CHUNK = 256
#: Votes of a token that is spelled out, marked as doubtful, abbreviated.
FULL, DOUBTFUL, SHORT = 1.0, 0.3, 0.2
#: Parts of a full name: given name, patronymic and surname.
PARTS = 3
GAP, CLASH = -0.6, -1.0
#: Months by their first letters, in Latin and Ukrainian spelling.
MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)} | {m: k for k, m in enumerate("січ лют бер кві тра чер лип сер вер жов лис гру".split(), 1)}
#: What each part of an event adds to its completeness; a finer date outweighs place and citation.
EVENT_PARTS = {"year": 16.0, "month": 8.0, "day": 4.0, "place": 2.0, "cited": 1.0}

Token = tuple[str, float]  #: key (or * for an unreadable token, x. for an initial) and vote


def name_tokens(name: str | None) -> list[Token]:
    """Tokens in the order given name, patronymic, surname.

    A surname in front is told by a comma, by capitals, or by a patronymic or an initial
    that ends the name.
    """
    if not name or not name.strip():
        return []
    raw = [t for t in re.split(r"[\s,]+", name.strip()) if t]
    letters = lambda t: re.sub(r"[^\w'’ʼ-]|[\d_]", "", t)
    front = len(raw) > 1 and (
        re.match(r"^\S+,", name.strip()) is not None
        or (len(letters(raw[0])) > 2 and letters(raw[0]).isupper() and not letters(raw[1]).isupper())
        or (len(raw) > 2 and re.search(r"(oviC|eviC|iviC|ovna|evna|ivna)$", skeleton(letters(raw[-1]))) is not None and "." not in raw[-1])
        or (raw[-1].endswith(".") and not raw[0].endswith(".") and len(raw) == 2)
    )
    if front:
        raw = raw[1:] + raw[:1]
    out: list[Token] = []
    for t in raw:
        word = letters(re.sub(r"\[[^\]]*\]", "", t))
        if not word:
            out.append(("*", 0.0))
        elif t.rstrip("?[]()").endswith(".") or len(word) < 2:
            out.append((skeleton(word)[:1] + ".", SHORT))
        elif re.search(r"[?\[\]*]", t):
            out.append((skeleton(word), DOUBTFUL))
        else:
            out.append((skeleton(word) or word.lower(), FULL))
    return out


def date_parts(raw: str | None) -> dict[str, str]:
    """year, month and day as far as a plain date gives them; nothing for approximate, bounded, open or missing dates."""
    t = (raw or "").strip().lower()
    m = re.fullmatch(r"(\d{3,4})-(\d{1,2})(?:-(\d{1,2}))?", t)
    if m:
        return {k: str(int(v)) for k, v in zip(("year", "month", "day"), m.groups()) if v}
    m = re.fullmatch(r"(\d{1,2})[./](\d{1,2})[./](\d{3,4})", t)
    if m:
        return {"day": str(int(m[1])), "month": str(int(m[2])), "year": str(int(m[3]))}
    m = re.fullmatch(r"(?:(\d{1,2})\s+)?([^\W\d_]{3,})\.?\s+(\d{3,4})(?:\s*(?:р|року|r|roku)\.?)?", t)
    if m and m[2][:3] in MONTHS:
        return {"year": str(int(m[3])), "month": str(MONTHS[m[2][:3]])} | ({"day": str(int(m[1]))} if m[1] else {})
    m = re.fullmatch(r"(\d{3,4})(?:\s*(?:р|року|r|roku)\.?)?", t)
    return {"year": str(int(m[1]))} if m else {}


def event_tokens(value: str | None) -> list[Token]:
    raw, place, cited = (value or "\x01" + "00").rsplit("\x01", 1)[0], (value or "00")[-2:-1], (value or "00")[-1:]
    parts = date_parts(raw) | ({"place": "1"} if place == "1" else {}) | ({"cited": "1"} if cited == "1" else {})
    return [(f"{k}:{parts[k]}", EVENT_PARTS[k]) for k in EVENT_PARTS if k in parts]


def tokens(field: str, value: str | None) -> list[Token]:
    return name_tokens(value) if field == "name" else event_tokens(value)


#: What a token's best supporter offers: minus its completeness, imported, age, source; less is better.
Strength = tuple[float, int, int, str]
#: Per column the tokens with their best supporter and the number of all supporters.
Profile = list[dict[str, tuple[Strength, int]]]


def completeness(field: str, own: list[Token]) -> float:
    votes = sorted((w for _, w in own), reverse=True)
    return sum(votes[:PARTS] if field == "name" else votes)


def _likeness(column: Iterable[str], keys: Iterable[str]) -> float:
    best = CLASH
    for k in keys:
        for c in column:
            if k == c:
                return 2.0
            if ":" in k and ":" in c:
                best = max(best, 1.0) if k.split(":")[0] == c.split(":")[0] else best
            elif "*" in (k, c):
                best = max(best, 0.1)
            elif (k.endswith(".") or c.endswith(".")) and k[:1] == c[:1]:
                best = max(best, 1.2)
    return best


def align(profile: list, other: list) -> list[tuple[int, int]]:
    """Pairs (column of profile or -1, column of other or -1) of the best global alignment."""
    n, m = len(profile), len(other)
    score = [[j * GAP for j in range(m + 1)]]
    for i in range(1, n + 1):
        row = [i * GAP]
        for j in range(1, m + 1):
            row.append(max(score[i - 1][j - 1] + _likeness(profile[i - 1], other[j - 1]), score[i - 1][j] + GAP, row[j - 1] + GAP))
        score.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and abs(score[i][j] - score[i - 1][j - 1] - _likeness(profile[i - 1], other[j - 1])) < 1e-9:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and abs(score[i][j] - score[i - 1][j] - GAP) < 1e-9:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def merge(profile: Profile, other: Profile) -> Profile:
    """The profile of both, column by column."""
    out: Profile = []
    for i, j in align(profile, other):
        column = dict(profile[i]) if i >= 0 else {}
        if j >= 0:
            for k, (strength, n) in other[j].items():
                had = column.get(k)
                column[k] = (min(had[0], strength), had[1] + n) if had else (strength, n)
        out.append(column)
    return out


def progressive(profiles: list[Profile]) -> Profile:
    """All profiles in one, the most complete first."""
    ordered = sorted(profiles, key=lambda p: (-len(p), min(x for c in p for x, _ in c.values()), sorted(p[0])))
    out: Profile = []
    for p in ordered:
        out = merge(out, p) if out else p
    return out


def consensus(profile: Profile, parts: int = PARTS) -> list[str]:
    """The winning token of each of the ``parts`` columns with the strongest winners, in order.

    One value that spells a part out is enough for its column: rare parts are often those
    that the other values lack.
    """
    top = []
    for at, column in enumerate(profile):
        votes = [(strength, -n, k) for k, (strength, n) in column.items() if k != "*"]
        if votes:
            top.append((min(votes), at))
    kept = sorted(top)[:parts]
    return [vote[2] for vote, _ in sorted(kept, key=lambda x: x[1])]


def distance(field: str, value: str | None, agreed: list[str]) -> float:
    """Weight of the consensus columns that a value lacks, leaves short or doubtful, or contradicts."""
    own = tokens(field, value)
    if field != "name":  # the columns of events bear names
        have = {k for k, _ in own}
        return sum(EVENT_PARTS[k.split(":")[0]] for k in agreed if k not in have)
    if [k for k, _ in own] == agreed:
        return round(len(own) - sum(vote for _, vote in own), 6)
    far = float(len(agreed))
    for i, j in align([[k] for k in agreed], [[k] for k, _ in own]):
        if i >= 0 and j >= 0 and (own[j][1] < FULL or own[j][0] == agreed[i]):
            far -= own[j][1]
    return round(far, 6)


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal keys, over the borders of batches."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from batch.itertuples(index=False, name=None)

    n = len(keys)
    for key, run in groupby(rows(), key=lambda r: r[:n]):
        yield key, [r[n:] for r in run]


def _in_chunks(df: DataFrame, keys: list[str], columns: list[str], run, schema: str) -> DataFrame:
    return df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def survivors(values: DataFrame) -> DataFrame:
    """(group, field, source) of the surviving value of each group and field.

    ``values``: group, field (``name`` or an event field), value, source, imported (0 for the
    existing record), at.  Null values take part and lack every column; groups without any
    readable value keep the existing record; repeated rows change nothing; an empty table
    gives none.
    """
    scratch = Scratch(values.sparkSession, "survivors")
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    trust = F.struct("imported", F.coalesce(-micros, F.lit((1 << 63) - 1)).alias("age"), "source")
    base = values.groupBy("group", "field", "value").agg(F.count(F.lit(1)).alias("n"), F.min(trust).alias("best"))
    base = scratch.save(base.select(F.concat_ws("\x01", "field", "group").alias("at"), "group", "field", "value", "n", "best.*"))
    per_group = scratch.save(base.groupBy("at").agg(F.count(F.lit(1)).alias("values")).withColumn("chunks", F.ceil(F.col("values") / CHUNK).cast("int")))
    chunks = per_group.agg(F.max("chunks")).first()[0] or 1
    keys = ["at", "chunk"]

    def agree(at: str, profile: Profile) -> list[str]:
        return consensus(profile, PARTS if at.startswith("name\x01") else len(EVENT_PARTS))

    def first(last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = []
            for key, rows in _groups(batches, keys):
                field = key[0].split("\x01", 1)[0]
                profiles = []
                for value, n, *by in rows:
                    own = tokens(field, value)
                    if own:
                        profiles.append([{k: ((-completeness(field, own), *by), n)} for k, _ in own])
                whole = progressive(profiles)
                out.append((*key, json.dumps(agree(key[0], whole) if last else whole)))
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=[*keys, "profile"])
                    out = []
            yield pd.DataFrame(out, columns=[*keys, "profile"])

        return run

    def again(last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            read = lambda text: [{k: (tuple(s), n) for k, (s, n) in c.items()} for c in json.loads(text)]
            out = []
            for key, rows in _groups(batches, keys):
                whole = progressive([p for p in (read(x) for (x,) in rows) if p])
                out.append((*key, json.dumps(agree(key[0], whole) if last else whole)))
            yield pd.DataFrame(out, columns=[*keys, "profile"])

        return run

    schema = "at string, chunk int, profile string"
    spread = counted_join(base, per_group.withColumnRenamed("values", "members"), "at", "members", how="inner").withColumn("chunk", F.pmod(F.xxhash64("value"), F.col("chunks")).cast("int"))
    profiles = _in_chunks(spread, keys, ["value", "n", "imported", "age", "source"], first(chunks == 1), schema)
    while chunks > 1:
        chunks = -(-chunks // CHUNK)
        profiles = scratch.save(profiles).withColumn("chunk", F.expr(f"chunk div {CHUNK}"))
        profiles = _in_chunks(profiles, keys, ["profile"], again(chunks == 1), schema)
    # only the few tokens of the consensus go back to the values
    agreed = scratch.save(profiles.select("at", "profile").join(per_group.select("at", "values"), "at"))

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            far = [distance(field, value, json.loads(tokens_)) for field, value, tokens_ in zip(batch["field"], batch["value"], batch["profile"])]
            yield batch.drop(columns=["value", "profile"]).assign(far=far)[["group", "field", "far", "imported", "age", "source"]]

    judged = counted_join(base, agreed, "at", "values", how="inner").select("group", "field", "value", "profile", "imported", "age", "source")
    far = judged.mapInPandas(distances, "group string, field string, far double, imported int, age bigint, source string")
    return far.groupBy("group", "field").agg(F.min(F.struct("far", "imported", "age", "source"))["source"].alias("source"))


def duplicate_values(candidates: DataFrame) -> DataFrame:
    """The values that proposals of duplicates of existing persons offer, in long form for :func:`survivors`."""
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    rows = candidates.filter((F.col("candidate_scope") == "import_vs_tree") & F.col("status").isin("suggested", "accepted")).select(
        clean(F.col("existing_tree_person_id")).alias("group"), clean(F.col("import_tree_person_id1")).alias("import1"),
        "import_person1_name", "existing_person_name", F.coalesce("updated_at", "created_at").alias("at"), "events",
    ).filter("`group` is not null")
    name = F.lit("name").alias("field")
    existing = rows.select("group", name, F.col("existing_person_name").alias("value"), F.col("group").alias("source"), F.lit(0).alias("imported"), "at")
    imported = rows.filter("import1 is not null").select("group", name, F.col("import_person1_name").alias("value"), F.col("import1").alias("source"), F.lit(1).alias("imported"), "at")
    event = rows.select("group", "import1", "at", F.explode("events").alias("e")).filter(F.col("e.event_type").isin("BIRT", "DEAT"))
    given = lambda c: F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) > 0, "1").otherwise("0")
    own = F.col("e.side") == "existing"
    events = event.select(
        "group", F.when(F.col("e.event_type") == "BIRT", "birth").otherwise("death").alias("field"),
        F.concat(F.coalesce("e.date_raw", F.lit("")), F.lit("\x01"), given(F.col("e.place_raw")), F.when(F.coalesce("e.has_source_citation", F.lit(False)), "1").otherwise("0")).alias("value"),
        F.when(own, F.col("group")).otherwise(F.col("import1")).alias("source"), F.when(own, 0).otherwise(1).alias("imported"), "at",
    ).filter("source is not null")
    return existing.unionByName(imported).unionByName(events)
