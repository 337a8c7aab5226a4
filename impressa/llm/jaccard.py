"""N-gram Jaccard join by set-relation skipping.

Documents are sets of word shingles; two link when 100 * |A n B| >= 75 * |A u B|.

1. Equal sets become one class (a shuffle of one short row per document).
2. Shingles are ordered from rare to frequent by document-frequency level
   (``sharing.frequency_levels``), then hash.  A shingle of level 0 is in one
   class only: it can match nothing, yet it takes a place in the order, so a set
   with over a quarter of them is done without any index entry.
3. Index lists: each shared shingle among the first |A| - ceil(0.75 |A|) + 1
   lists (class, size, position).
4. Answers by relation: each list has a hub, the class that holds the shingle
   earliest.  Classes are compared with the hubs of their lists only; one that
   links with a hub takes over the hub's component and needs no comparison with
   the others of that component.
5. Block skipping: what is left are pairs of different components.  Lists are
   grouped in blocks by position and size; a pair of blocks is skipped if it is
   of one component, or if sizes and positions bound the overlap below need.
   Only pairs in surviving blocks are compared.
6. Compared pairs are checked exactly on their sets.

Lists of one component and hot passages never expand to pairs of all members,
and nothing is capped: every pair over the threshold is compared, or its two
members are already known to be in one component.

Null and empty texts have an empty set and link with nothing; fewer words than
a shingle make one shingle; rows that repeat a doc_id must repeat its text (of
different texts one stands for all); null ids get a null component; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.components import components
from impressa.llm.shared import cut, fresh, keyed, spread_join, trimmed
from impressa.llm.sharing import frequency_levels, id_bitmap, levels_of, maybe_in
from impressa.llm.text import SPACED, documents_of, mix, run_hash

WORDS = 5
PERCENT = 75


def _sets(batch, n: int):
    """(first document, chunk, shingle documents, shingles), sorted and distinct per document."""
    for first, _, w in documents_of(batch, "text", SPACED):
        h = w.hash
        _, keys = w.windows(n, h)
        doc = w.doc[_] if len(keys) else np.zeros(0, np.int64)
        short = np.flatnonzero((w.count > 0) & (w.count < n))
        if len(short):
            own = np.array([run_hash(h, np.array([w.first[d]]), int(w.count[d]))[0] for d in short], np.uint64)
            doc, keys = np.concatenate([doc, short]), np.concatenate([keys, own])
        order = _by_document(doc, keys)
        doc, keys = doc[order], keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        yield first, w, doc[new], keys[new]


def _by_document(doc, keys, level=None):
    """Order by document, level and key: one sort of 64-bit words, or all keys if their high bits tie."""
    level = np.zeros(1, np.uint8) if level is None else level
    word = (doc.astype(np.uint64) << np.uint64(42)) | (level.astype(np.uint64) << np.uint64(38)) | (keys >> np.uint64(26))
    order = np.argsort(word)
    same = word[order][1:] == word[order][:-1]
    if (same & (keys[order][1:] != keys[order][:-1])).any():
        return np.lexsort((keys, np.broadcast_to(level, len(keys)), doc))
    return order


def signatures(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, n (set size) and two 64-bit signatures of the set."""

    @trimmed
    def run(batches):
        for batch in batches:
            size, a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for _, w, doc, keys in _sets(batch, n):
                size.append(np.bincount(doc, minlength=w.n_docs))
                for out, salt in ((a, 0x1234567F), (b, 0x7654321D)):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys * np.uint64(salt)), dtype=np.uint64)))
                    ends = np.cumsum(size[-1])
                    out.append(mix(sums[ends] - sums[ends - size[-1]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(size)), pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["doc_id", "n", "s1", "s2"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def _prefixes(docs, reps, levels, n, percent):
    """Index entries (token, id, n, pos) of the shared shingles in the prefix of each class."""

    @trimmed
    def run(batches):
        for batch in batches:
            inside, ids = maybe_in(reps.value, batch.column("doc_id")), batch.column("doc_id").fill_null(0).to_numpy()
            batch = batch.filter(pa.array(inside))
            ids = ids[inside]
            for first, w, doc, keys in _sets(batch, n):
                level = levels_of(levels.value, keys)
                order = _by_document(doc, keys, level)
                doc, keys, level = doc[order], keys[order], level[order]
                size = np.bincount(doc, minlength=w.n_docs)
                pos = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
                limit = size - -(-percent * size // 100) + 1
                use = np.flatnonzero((pos < limit[doc]) & (level > 0))
                yield pa.RecordBatch.from_arrays([pa.array(keys[use].view(np.int64)), pa.array(ids[doc[use] + first]), pa.array(size[doc[use]].astype(np.int32)), pa.array(pos[use].astype(np.int32))], ["token", "id", "n", "pos"])

    return docs.mapInArrow(run, "token long, id long, n int, pos int")


def _possible(na, pa_, nb, pb, percent):
    """Can sets of these sizes link, if their first common shingle is at these positions?"""
    need = percent * (na + nb)  # overlap * (100 + percent) >= percent * (na + nb)
    reach = F.least(na - pa_, nb - pb)
    return (reach * (100 + percent) >= need) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


def _verify(docs, pairs, levels, n, percent):
    """Of pairs (a, b, na, nb), those that link, checked on the shared shingles of both."""
    ids = id_bitmap(pairs.select("a").union(pairs.select("b")))

    @trimmed
    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(maybe_in(ids.value, batch.column("doc_id"))))
            own = batch.column("doc_id").to_numpy()
            for first, w, doc, keys in _sets(batch, n):
                shared = levels_of(levels.value, keys) > 0
                doc, keys = doc[shared], keys[shared]
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=w.n_docs)))) * 8
                raw = pa.Array.from_buffers(pa.large_binary(), w.n_docs, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own[first : first + w.n_docs]), raw], ["id", "set"])

    held = docs.mapInArrow(sets, "id long, set binary").dropDuplicates(["id"])
    rows = spread_join(pairs, held.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b", F.col("a")).join(held.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")

    @trimmed
    def check(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum()) if len(y) else 0
                keep[i] = (100 + percent) * common >= percent * (int(na[i]) + int(nb[i]))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return rows.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(check, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), class_id (smallest doc_id with an equal set)."""
    docs = keyed(docs, id_col, text_col)
    rows = cut(signatures(docs, n))
    reps = cut(rows.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))
    inside = id_bitmap(reps.select("rep"))

    def keys_of(batch):
        batch = batch.filter(pa.array(maybe_in(inside.value, batch.column("doc_id"))))
        for first, _, doc, keys in _sets(batch, n):
            yield doc + first, keys

    levels = frequency_levels(docs, keys_of)
    # a class may be in the bitmap by chance without being a representative: the join keeps representatives
    index = _prefixes(docs, inside, levels, n, percent)
    index = index.dropDuplicates(["token", "id"])
    hubs = index.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("pos", "n", "id")).alias("h")).where("m > 1")
    hubs = hubs.select(F.col("token").alias("t"), F.col("h.pos").alias("hpos"), F.col("h.n").alias("hn"), F.col("h.id").alias("hub"))
    index = cut(index.join(hubs, F.col("token") == F.col("t")).drop("t"))

    near = index.where((F.col("id") != F.col("hub")) & _possible(F.col("n"), F.col("pos"), F.col("hn"), F.col("hpos"), percent))
    pairs = cut(near.select(F.col("id").alias("a"), F.col("hub").alias("b"), F.col("n").alias("na"), F.col("hn").alias("nb")).distinct())
    links = cut(_verify(docs, pairs, levels, n, percent))
    comp = components(links)

    live = index.select("token", "id", "n", "pos").join(comp, F.col("id") == F.col("node"), "left").select("token", "id", "n", "pos", F.coalesce("component", "id").alias("comp"))
    live = cut(live)
    mixed = live.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select(F.col("token").alias("t"))
    live = cut(live.join(mixed, F.col("token") == F.col("t"), "left_semi"))
    blocks = cut(live.groupBy("token", "pos", "n").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")))
    a, b = blocks.alias("a"), blocks.alias("b")
    one = (F.col("a.c0") == F.col("a.c1")) & (F.col("b.c0") == F.col("b.c1")) & (F.col("a.c0") == F.col("b.c0"))
    meet = (F.col("a.token") == F.col("b.token")) & (F.struct("a.pos", "a.n") <= F.struct("b.pos", "b.n")) & ~one & _possible(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"), percent)
    met = a.join(b, meet).select(F.col("a.token").alias("token"), F.col("a.pos").alias("pos"), F.col("a.n").alias("n"), F.col("b.pos").alias("pos2"), F.col("b.n").alias("n2"))
    met = met.join(live, ["token", "pos", "n"]).select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), "pos2", "n2")
    other = live.select("token", F.col("pos").alias("pos2"), F.col("n").alias("n2"), F.col("id").alias("b"), F.col("comp").alias("cb"))
    met = met.join(other, ["token", "pos2", "n2"]).where("a <> b and ca <> cb")
    swap = F.col("a") > F.col("b")
    rest = met.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(swap, F.col("n2")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("n2")).alias("nb")).distinct()
    rest = cut(rest.join(pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti"))
    if not rest.isEmpty():
        more = cut(_verify(docs, rest, levels, n, percent))
        if not more.isEmpty():
            comp = components(links.union(more))

    found = reps.join(comp, F.col("rep") == F.col("node"), "left").select(F.col("s1").alias("x"), F.col("s2").alias("y"), F.col("n").alias("z"), "rep", F.coalesce("component", "rep").alias("component"))
    return rows.join(found, (F.col("s1") == F.col("x")) & (F.col("s2") == F.col("y")) & (F.col("n") == F.col("z")), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that are the smallest of their component, with all their columns.

    Documents without words stay.  The ids that go are joined without moving
    the texts if they are few; otherwise Spark shuffles.
    """
    key = fresh("_gone", docs)
    gone = cut(classes(docs, id_col, text_col, n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct())
    maybe = id_bitmap(gone)
    at = docs.schema.fieldNames().index(id_col)

    def part(concerned):
        @trimmed
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(maybe_in(maybe.value, batch.column(at).cast(pa.int64())) == concerned))

        return docs.mapInArrow(run, docs.schema)

    # only documents that may go are looked up: the others pass without a shuffle
    return part(False).unionByName(part(True).join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti"))
