"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's set is its distinct shingles of ``width`` words; documents are linked where the Jaccard
similarity of their sets reaches ``least`` percent, which is confirmed on the full sets.

Classes. Documents with equal sets are one class; only one row of each goes on, so thousands of copies
cost one grouped minimum.

Signatures. VALUES MinHash values of b = 16 bits. Two sets of similarity 0.8 differ in about a fifth of
the values, and in more than ERRORS of them with a chance of about one in four millions; that is the
signature-distance threshold. The signature is split into chunks of CHUNK values, and by pigeonhole some
chunk of a pair within the threshold has one error at most. That error is enumerated: an index key is a
chunk, the place of the masked value and the CHUNK - 1 values left, so that a key takes three agreements
at once. Pairs within the threshold even share SHARED of their keys, however the errors fall; so of its
keys, ordered from rare to frequent over the corpus, a document needs all but the last SHARED - 1 (two
sets of keys that share so many must meet there), and keys of widely shared passages are not used unless
they fill much of a document. No pair within the threshold is lost, however frequent a key is.

Candidates. A set of which more shingles are its own than the similarity allows is like no other and drops out. Each key's members are first compared with one member, its hub: that with the fewest
shingles of its own, of edited copies the nearest to their origin. Confirmed links are closed to
components, and keys whose members are all in one component are done. When what is left is small, or a
round no longer halves it, every remaining pair of members of different components is compared: in keys
of up to LARGE members each pair at its first common key; in larger ones by a second key. Of two members in different
components at least one is not linked with the hub. If X is not, then it can be linked with Y only where
the two share a deviation from the hub: otherwise what they have in common is within what X and the
hub have, while their union is larger. So the second key is the hub and a deviation. How many deviations
two linked members share at least follows from one member's sizes, so that each gives a prefix of its own
alone: a fifth or a quarter of its shingles, whatever the size of the hub. Any hub will do, as members are
compared with it there; so hubs of one component give way to the first of them where they are near to it,
and a member does not meet the others of its family once for each of its keys. A shingle that both have
and the hub lacks is needed wherever the shingles common with the hub do not reach the similarity
alone; for the other pairs, one that the hub has and both lack. That is exact for any rest; hubs only make it short.

Hot keys. Counts and minima are added up before the shuffle; rows that share a key meet only tables of
one row for each key, and those joins are salted or split by Spark at run time.

Defined results: a null or empty text has an empty set, is linked with nothing, and is kept; a text of
fewer words than a shingle has its whole word sequence as its one shingle; repeated rows are copies, and
rows of different texts under one doc_id are compared each by itself; a null doc_id has the component_id
of its group, which is null, and the row kept, where no member has an id; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import mix, read, settle, small

VALUES, ERRORS, CHUNK = 128, 50, 4
#: The least number of keys that signatures within ERRORS share: one error in each chunk leaves it a key, a second takes that too.
SHARED = 2 * VALUES // CHUNK - ERRORS
#: Parts of the hash range in which a set's shingles are counted.
PARTS = 64
MAX_ROUNDS = 8
#: Members of a key beyond which its pairs are found by a second key.
LARGE = 32
SALTS = 16

_SALT = np.random.default_rng(20240607).integers(0, 2**32, VALUES, dtype=np.uint32)
_ODD = np.random.default_rng(7062024).integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_PRIME32 = np.uint32(0x9E3779B1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z are lower-cased."""
    if not isinstance(text, str):
        return np.zeros(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * _PRIME + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    """16 bits of the least hash under each of VALUES hash functions."""
    least = np.full(VALUES, np.iinfo(np.uint32).max, np.uint32)
    half = (own >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(half), 512):
        part = (half[k : k + 512, None] ^ _SALT) * _ODD
        np.minimum(least, part.min(axis=0), out=least)
    return ((least * _PRIME32) >> np.uint32(16)).astype(np.int32)


def _described(rows: DataFrame, width: int) -> DataFrame:
    """row, doc_id, n shingles, the set's 128-bit hash, and its signature."""

    @pandas_udf("n long, key binary, sig array<int>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = []
            for t in texts:
                own = shingles(t, width)
                found.append((len(own), xxhash.xxh3_128_digest(own.tobytes()), signature(own)) if len(own) else (0, None, None))
            yield pd.DataFrame(found, columns=["n", "key", "sig"])

    out = rows.select("row", "doc_id", describe("text").alias("d"))
    return out.select("row", "doc_id", F.col("d.n").alias("n"), F.col("d.key").alias("key"), F.col("d.sig").alias("sig"))


def _keys(reps: DataFrame) -> DataFrame:
    """(k, rep): the index keys of each signature. A key holds the place of the masked value and the others of its chunk."""

    def key(place: Column) -> Column:
        packed = place.cast("long")
        for step in range(1, CHUNK):
            at = place - place % CHUNK + (place + step) % CHUNK
            packed = packed * 65536 + F.get("sig", at)
        return packed

    return reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(VALUES - 1)), key)).alias("k"))


def _prefixes(reps: DataFrame) -> DataFrame:
    """(rep, n, sig, ks, common): each representative's keys in order from rare to frequent without the last SHARED - 1, without
    the keys that it alone has, and how common its keys are."""
    shared = _keys(reps).groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
    own = _keys(reps).join(shared.hint("shuffle_hash"), "k")
    # At most VALUES rows a representative.
    ranked = own.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "k"))).alias("ks"))
    first = F.greatest(F.lit(0), F.size("ks") - (SHARED - 1))
    common = F.aggregate("ks", F.lit(0.0), lambda n, x: n + F.log2(x["c"]))
    ranked = ranked.select("rep", F.transform(F.slice("ks", 1, first), lambda x: x["k"]).alias("ks"), F.round(common, 6).alias("common")).where(F.size("ks") > 0)
    return ranked.join(reps.select("rep", "n", "sig"), "rep")


def _within(a: str, b: str) -> Column:
    """Whether two signatures differ in ERRORS values at most."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same >= VALUES - ERRORS


def _could_reach(na: Column, ra: Column, nb: Column, rb: Column, least: int) -> Column:
    """Whether sets of n shingles, r of them found elsewhere too, may have the similarity."""
    common = F.least(ra, rb)
    return 100 * common >= least * (na + nb - common)


def _most_common(a: str, b: str) -> Column:
    """An upper bound of the common shingles of two sets: by part, the smaller count of those found elsewhere too."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)


def _found_elsewhere(sets: DataFrame) -> DataFrame:
    """(rep, r, parts): how many of its shingles another candidate has too, in all and by part of the hash range."""
    shingle = sets.select("rep", F.explode("set").alias("h"))
    owners = shingle.groupBy("h").agg(F.min("rep").alias("rep"), F.count("*").alias("c")).where("c = 1")
    alone = owners.groupBy("rep", F.pmod("h", F.lit(PARTS)).cast("int").alias("p")).agg(F.count("*").cast("int").alias("c"))
    alone = alone.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("p", "c"))).alias("alone"))  # PARTS entries at most
    parts = F.transform("counts", lambda n, i: n - F.coalesce(F.try_element_at("alone", i), F.lit(0)))
    found = sets.select("rep", "counts").join(alone, "rep", "left").select("rep", parts.alias("parts"))
    return found.select("rep", F.aggregate("parts", F.lit(0), lambda n, x: n + x).alias("r"), "parts")


def _near(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures are within the distance."""
    a, b = (profiles.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where(_within("sig_a", "sig_b")).select("a", "b")


def _possible(pairs: DataFrame, found_too: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose shingles, by part of the hash range, leave the similarity possible."""
    a, b = (found_too.select(F.col("rep").alias(x), F.col("parts").alias(f"parts_{x}")) for x in "ab")
    most = pairs.join(a, "a").join(b, "b").withColumn("most", _most_common("parts_a", "parts_b"))
    return most.where(100 * F.col("most") >= least * (F.col("na") + F.col("nb") - F.col("most"))).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    @pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= least * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    a, b = (sets.select(F.col("rep").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where(similar("set_a", "set_b")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches, by alternating stars."""
    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _deviations(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (hub, rep, ...) with held, added and missing: how many of the hub's shingles a member has, the others that it has, and those that it lacks."""

    @pandas_udf("held int, added array<long>, missing array<long>")
    def deviate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for own, hubs in batches:
            found = []
            for x, h in zip(own, hubs):
                held = np.isin(x, h, assume_unique=True)
                found.append((int(held.sum()), x[~held], h[~np.isin(h, x, assume_unique=True)]))
            yield pd.DataFrame(found, columns=["held", "added", "missing"])

    # A hub may have a large part of all rows: its set is repeated for each salt.
    hubs = rows.select("hub").distinct().join(sets.select(F.col("rep").alias("hub"), F.col("set").alias("hub_set")), "hub")
    hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = rows.join(sets.select("rep", "set"), "rep").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    return both.join(hubs, ["hub", "salt"]).withColumn("d", deviate("set", "hub_set")).select(*rows.columns, "d.held", "d.added", "d.missing")


def _prefix(deviation: str, shared: Column) -> Column:
    """How many of a deviation's shingles, in their order, two members meet in at least once if they share so many of them."""
    return F.size(deviation) - F.greatest(F.lit(1), shared.cast("int")) + 1


def _added_needed(held: str, added: str, n: str, least: int) -> Column:
    """Two members share least percent of either at least; what the hub does not hold of that is added."""
    return _prefix(added, F.ceil(least * F.col(n) / 100 - F.col(held)))


def _missing_needed(missing: str, n: str, least: int) -> Column:
    """The other member has at most 100 / least times the shingles, so that it holds few of those that are missing here."""
    return _prefix(missing, F.ceil(F.size(missing) - F.col(n) * (100 - least) / least))


def _fewer_hubs(hubs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(k, hub, hc) of hubs (k, o, hub, hc): the first hub of its component hc instead of each that is within the distance of it."""
    first = hubs.groupBy("hc").agg(F.min(F.struct("o", "hub")).alias("f")).select("hc", F.col("f.hub").alias("b"))
    pairs = hubs.select(F.col("hub").alias("a"), "hc").distinct().join(small(settle(first, "first-hubs")), "hc").select("a", "b")
    near = settle(_near(pairs, profiles), "near-hubs").withColumnRenamed("a", "hub")
    return hubs.join(small(near), "hub", "left").select("k", F.coalesce("b", "hub").alias("hub"), "hc")


def _by_deviation(rows: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b, na, nb) of rows (hub, hc, rep, n, r, c) with one hub that share a deviation from it and may be linked,
    and those of members with a hub of another component hc that they are linked with."""
    own = settle(_deviations(rows, sets), "deviations")
    token = own.select("hub", "rep", "n", "r", "c", "held", "added", _added_needed("held", "added", "n", least).alias("needed"))
    token = token.select("hub", "rep", "n", "r", "c", "held", (F.size("added") - F.col("needed")).alias("rest"), F.explode(F.slice("added", 1, F.col("needed"))).alias("h"))
    again = token.groupBy("hub", "h").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("hub", "h")
    token = token.join(again, ["hub", "h"])
    more = token.groupBy("hub", "rep").agg((F.count("*") + F.first("rest")).alias("more"))
    token = token.drop("rest").join(more, ["hub", "rep"])
    # Only members that the hub holds for the most part reach the similarity by what they share with it.
    lacks = own.where(100 * F.col("held") >= least * F.col("n")).select("hub", "rep", "n", "r", "c", "held", F.lit(0).alias("more"), F.explode(F.slice("missing", 1, _missing_needed("missing", "n", least))).alias("h"))

    def meet(t: DataFrame, enough) -> DataFrame:
        a, b = (t.select("hub", "h", *[F.col(c).alias(to + x) for c, to in (("rep", ""), ("n", "n"), ("r", "r"), ("c", "c"), ("held", "held"), ("more", "more"))]) for x in "ab")
        held, most = F.least("helda", "heldb"), F.least("helda", "heldb") + F.least("morea", "moreb")
        reaches = lambda c: (100 + least) * c >= least * (F.col("na") + F.col("nb"))
        possible = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _could_reach(*map(F.col, ("na", "ra", "nb", "rb")), least) & enough(reaches(held), reaches(most))
        return a.join(b, (a["hub"] == b["hub"]) & (a["h"] == b["h"]) & possible).select("a", "b", "na", "nb")

    size = F.col("held") + F.size("missing")
    with_hub = own.where((F.col("c") != F.col("hc")) & ((100 + least) * F.col("held") >= least * (F.col("n") + size)))
    with_hub = with_hub.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"), F.when(F.col("hub") < F.col("rep"), size).otherwise(F.col("n")).alias("na"), F.when(F.col("hub") < F.col("rep"), F.col("n")).otherwise(size).alias("nb"))
    return meet(token, lambda held, most: most).unionByName(meet(lacks, lambda held, most: held)).unionByName(with_hub).distinct()


def _links(members: DataFrame, rows: DataFrame, width: int, least: int) -> DataFrame | None:
    """Enough confirmed links (a, b) between representatives to connect whatever is linked."""
    reps = members.where("key IS NOT NULL AND row = rep").select("rep", "n", "sig")
    profiles = settle(_prefixes(reps), "profiles")
    if profiles.isEmpty():
        return None

    @pandas_udf("set array<long>, counts array<int>")
    def as_set(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            own = [shingles(t, width).view(np.int64) for t in texts]
            counts = [np.bincount(x % PARTS, minlength=PARTS).astype(np.int32) for x in own]
            yield pd.DataFrame({"set": own, "counts": counts})

    texts = rows.select(F.col("row").alias("rep"), "text").join(small(profiles.select("rep")), "rep")
    sets = settle(texts.select("rep", as_set("text").alias("s")).select("rep", "s.set", "s.counts"), "sets")
    found_too = settle(_found_elsewhere(sets), "found")
    # Sets with too many shingles of their own are like no other, whatever keys they share.
    hopeful = profiles.join(found_too.select("rep", "r"), "rep").where(100 * F.col("r") >= least * F.col("n"))
    keys = settle(hopeful.select("rep", "n", "common", "r", F.explode("ks").alias("k")), "keys")
    links, before = None, float("inf")
    labelled = keys.withColumn("c", F.col("rep"))
    for turn in range(MAX_ROUNDS + 1):
        if links is not None:
            named = components(links).select(F.col("node").alias("rep"), F.col("component").alias("found"))
            labelled = keys.join(named, "rep", "left").withColumn("c", F.coalesce("found", "rep")).drop("found")
        by_component = labelled.groupBy("k", "c").agg(F.count("*").alias("n1"))
        spread = by_component.groupBy("k").agg(F.sum("n1").alias("n"), F.sum(F.col("n1") * F.col("n1")).alias("same"), F.count("*").alias("cs")).where("cs > 1")
        spread = spread.select("k", F.col("n").alias("members"), ((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs"))
        labelled = settle(labelled.join(spread, "k"), "open-keys")
        # A key's pairs are spread over its rows, so that the sum counts each key once.
        rows_left, pairs_left = labelled.agg(F.count("*"), F.sum(F.col("pairs") / F.col("members"))).first()
        if not rows_left:
            return links
        last = pairs_left <= 2 * rows_left or pairs_left > before / 2 or turn == MAX_ROUNDS
        before = pairs_left
        own = labelled.select("k", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra"), F.col("c").alias("ca"))
        other = (F.col("ca") != F.col("cb")) & _could_reach(*map(F.col, ("na", "ra", "nb", "rb")), least)
        # The first hub has the fewest shingles of its own: of copies with edits it is the original, or next to it.
        central = F.struct(F.round((F.col("n") - F.col("r")) / F.col("n"), 3).alias("alone"), (-F.col("common")).alias("common"))
        if last:
            # Hubs are of use where many members are linked with them; without a round the pairs are few.
            plain = labelled.where(F.col("members") <= LARGE) if turn and pairs_left > 2 * rows_left else labelled
            full = plain.join(profiles.select("rep", "sig", "ks"), "rep")
            left, right = (full.select("k", *[F.col(c).alias(to + x) for c, to in (("rep", ""), ("n", "n"), ("r", "r"), ("c", "c"), ("sig", "sig_"), ("ks", "ks_"))]) for x in "ab")
            first = F.element_at(F.array_intersect("ks_a", "ks_b"), 1) == left["k"]
            pairs = left.join(right, (left["k"] == right["k"]) & (F.col("a") < F.col("b")) & other & first & _within("sig_a", "sig_b")).select("a", "b", "na", "nb")
            if plain is not labelled:
                big = labelled.where(F.col("members") > LARGE)
                hub = big.groupBy("k").agg(F.min(F.struct(central.alias("o"), F.col("rep").alias("hub"), F.col("c").alias("hc"))).alias("h")).select("k", "h.*")
                hub = _fewer_hubs(settle(hub, "hubs"), profiles)
                pairs = pairs.unionByName(_by_deviation(big.join(hub, "k").select("hub", "hc", "rep", "n", "r", "c").distinct(), sets, least)).distinct()
            pairs = _possible(pairs, found_too, least)
        else:
            order = F.struct((F.xxhash64("rep", F.lit(turn)) if turn else central).alias("o"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"), F.col("c").alias("cb"))
            hub = labelled.groupBy("k").agg(F.min(order).alias("h")).select("k", "h.b", "h.nb", "h.rb", "h.cb")
            pairs = own.join(hub, "k").where(other).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            pairs = _near(pairs, profiles)
        found = settle(_confirmed(pairs, sets, least), "links")
        links = found if links is None else links.unionByName(found)
        if last:
            return links
    return links


def _grouped(rows: DataFrame, width: int, least: int) -> DataFrame:
    """(row, doc_id, n, component) of settled rows (row, doc_id, text); component is a row of the group."""
    described = settle(_described(rows, width), "signatures")
    # Sets with copies are few beside all sets, and most rows need no join.
    classes = described.where("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("least_row"), F.count("*").alias("c")).where("c > 1").select("key", "least_row")
    joined = described.join(small(settle(classes, "classes")), "key", "left")
    members = settle(joined.select("row", "doc_id", "n", "key", "sig", F.coalesce("least_row", "row").alias("rep")), "members")
    links = _links(members, rows, width, least)
    out = members.select("row", "doc_id", "n", "rep")
    if links is None:
        return out.withColumnRenamed("rep", "component")
    named = settle(components(links), "components").withColumnRenamed("node", "rep")
    return out.join(small(named), "rep", "left").select("row", "doc_id", "n", F.coalesce("component", "rep").alias("component"))


def _chosen(grouped: DataFrame) -> DataFrame:
    """(component, component_id, stays) of groups of several rows: the smallest doc_id and the row that has it."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = grouped.groupBy("component").agg(F.min(order).alias("b"), F.count("*").alias("c")).where("c > 1")
    return small(settle(best.select("component", F.col("b.doc_id").alias("component_id"), F.col("b.row").alias("stays")), "chosen"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, settled, so that it stays the same if a task is repeated."""
    return settle(docs.withColumn("row", F.monotonically_increasing_id()), "rows")


def near_duplicates(docs: DataFrame, width: int = 5, least: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of docs (doc_id, text); kept is doc_id = component_id, and true in groups without an id."""
    grouped = settle(_grouped(numbered(docs.select("doc_id", "text")), width, least), "grouped")
    out = grouped.join(_chosen(grouped), "component", "left")
    component = F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.when(component.isNull(), F.col("stays").isNull() | (F.col("row") == F.col("stays"))).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False)))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, least: int = 80) -> DataFrame:
    """One row of each group of docs (doc_id, text, ...), with all its columns: that of the smallest doc_id."""
    rows = numbered(docs)
    grouped = settle(_grouped(rows.select("row", "doc_id", "text"), width, least), "grouped")
    away = grouped.join(_chosen(grouped), "component").where("row <> stays").select("row")
    return rows.join(away, "row", "left_anti").drop("row")


def op10(spark, sf_dir) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), width=4, least=80)
