"""Near-duplicate texts by the Jaccard similarity of their word shingles, with signature trees.

1. Each text becomes a set of 64-bit shingle hashes. Shingles that many texts share (HOT_LEAST * SAMPLE
   different texts or more, counted over all; at most HOT_MOST of them) are put last, all others in order of their hash.
2. A set's keys are its first shingles in that order: enough that two sets with a similarity of 3/4
   have none in common with a probability below 4e-15 (KEYS for a set without common shingles), or so
   many that they never have none. Texts that share no more than a common passage thus meet nowhere.
   Texts with equal sets form a class; a class is handled once, through one of its texts.
3. Classes with a key in common form a block; of blocks with the same members one is kept. A block
   beyond BLOCK_BYTES is dealt by size, each class with those whose size the similarity allows.
   In each block, a signature tree over the classes' bitmaps is traversed against itself; classes
   that the bitmaps can't keep apart are chained together. The chains' components are clusters. Of a block
   that is too large even so all members go to one cluster: its trees are built in step 4, chunk by chunk.
4. Each cluster is settled with whole sets: a signature tree proposes pairs, exact overlaps decide.
   Clusters beyond CHUNK_TOKENS are cut into chunks that are settled each on its own; then one class
   of each group found is compared with those of other chunks; and at last every class outside the
   cluster's largest group is compared with all classes of other groups, chunk by chunk. What is
   left out by this are pairs inside one group, which change nothing.

No task sees more than a block of BLOCK_BYTES, some chunks of CHUNK_TOKENS shingles or those of
COUNT_BYTES of text when they are counted, and no pair is
left unseen unless its two classes are already known to belong together. What the driver and the
broadcasts hold are the HOT_MOST common shingles (8 bytes each), whatever the input; with none of them the
result is the same, at more cost. The last step's cost grows with the classes outside a cluster's
largest group times the cluster: little where a cluster is a family of copies, much where ever more texts
are alike to more than about a half and less than three quarters, all with each other.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.bloom import bloom_filter, digest_of, flat, may_hold, rows_that_may_match
from brindle.llm.common import forget, fresh_prefix, join_hot, map_arrow, stored
from brindle.llm.components import components
from brindle.llm.signature_tree import Groups, bitmap, similar_groups, width_of
from brindle.llm.spans import texts_of, window_hashes, word_hashes, word_spans
from brindle.llm.tokens import release_encoders

SHINGLE, KEYS, BLOCK_BYTES, CHUNK_TOKENS = 5, 24, 1 << 22, 1 << 20
NUM, DEN = 3, 4  # a similarity of 0.75
#: A common shingle is in HOT_LEAST * SAMPLE texts or more. All texts are counted; SAMPLE is only a factor, which keeps the name it had when one text in so many was.
SAMPLE, HOT_LEAST = 16, 5
#: How many shingles are put last at most; bytes of text whose shingles are counted together, about; shingles that are summed before they are dealt out.
HOT_MOST, COUNT_BYTES, COUNT_TOKENS = 1 << 20, 1 << 22, 1 << 20
#: Bytes of a class in a block besides its bitmap, about; ratio of sizes that share a band (a little over 4/3).
_ROW_BYTES, _BAND = 200, 1.34


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text; A-Z count as a-z.

    A text of fewer than k words has one shingle, its whole sequence; one without words has none.
    """
    starts, ends, owner = word_spans(data, at)
    words = word_hashes(data, starts, ends, fold=True)
    first = np.searchsorted(owner, np.arange(len(at)))
    windows = window_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(windows[a : b - k + 1]))
        else:
            out.append(window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _class_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _planes(values: np.ndarray) -> bytes:
    """64-bit values by the byte, the first bytes of all first: those of ascending values are much alike, and compress."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes() if len(values) else b""


def _values(planes: list[bytes]) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view(">u8").ravel() for x in planes]
    return np.concatenate([np.zeros(0, np.uint64), *parts]).astype(np.uint64)


def _dealt_shingles(spread, parts: int):
    """Shingles by ranges of their hash: those met once, those met more often with how often, and those of texts that may be repeated, each with its text's salt.

    About COUNT_TOKENS shingles are summed at a time. spread: a filter of the repeated salts, or None.
    """
    low = np.array([-(-(i << 64) // parts) for i in range(parts)], np.uint64)  # where each range begins

    def run(batches):
        release_encoders()
        held, doubtful, size = [], {}, 0

        def summed():
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            theirs = np.concatenate([np.zeros(0, np.uint64), *doubtful.values()])
            salts = np.repeat(np.fromiter(doubtful, np.int64, len(doubtful)), [len(x) for x in doubtful.values()]).view(np.uint64)
            by = np.argsort(theirs, kind="stable")
            theirs, salts = theirs[by], salts[by]
            ones, many, times = token[n == 1], token[n > 1], n[n > 1].astype(np.uint64)
            cuts = [[*np.searchsorted(x, low).tolist(), len(x)] for x in (ones, many, theirs)]
            rows = []
            for i in range(parts):
                (a, b), (c, d), (e, f) = ((x[i], x[i + 1]) for x in cuts)
                if a < b or c < d or e < f:
                    rows.append((i, _planes(ones[a:b]), _planes(many[c:d]), _planes(times[c:d]), _planes(theirs[e:f]), _planes(salts[e:f])))
            step = -(-len(rows) // 8)  # about 1 MB
            for i in range(0, len(rows), step) if rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[i : i + step], strict=True), (pa.int64(), *[pa.binary()] * 5), strict=True)], names=_DEALT_NAMES)

        for b in batches:
            owners = b.column("salt").to_pylist()
            again = np.zeros(len(owners), bool) if spread is None else may_hold(flat(b.column("sha")), *spread.value)
            for s, salt, twice in zip(shingle_sets(*texts_of(b.column("text"))), owners, again.tolist(), strict=True):
                if not twice:
                    held.append(s)
                elif salt not in doubtful:
                    doubtful[salt] = s
                else:
                    continue
                size += len(s)
                if size > COUNT_TOKENS:
                    yield from summed()
                    held, doubtful, size = [], {}, 0
        if size:
            yield from summed()

    return run


_DEALT_NAMES = ["part", "ones", "many", "times", "theirs", "salts"]
_DEALT = "part long, ones binary, many binary, times binary, theirs binary, salts binary"


def _counted_shingles(least: int):
    """Shingles of ``least`` texts or more, from the dealt ones sorted by part; a text counts once, however often it is repeated."""

    def run(batches):
        for rows in _rows_by(batches, "part"):
            ones, many, times, theirs, salts = (_values([r[k] for r in rows]) for k in _DEALT_NAMES[1:])
            by = np.lexsort((salts, theirs))
            theirs, salts = theirs[by], salts[by]
            theirs = theirs[np.concatenate([[True], (theirs[1:] != theirs[:-1]) | (salts[1:] != salts[:-1])])[: len(theirs)]]
            token = np.concatenate([ones, theirs, many])
            n = np.concatenate([np.ones(len(ones) + len(theirs), np.int64), times.astype(np.int64)])
            by = np.argsort(token, kind="stable")
            token, n = token[by], n[by]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            n = np.add.reduceat(n, first)
            own = n >= least
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[first][own].view(np.int64)), pa.array(n[own])], names=["token", "n"])

    return run


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Ascending hashes of the HOT_MOST shingles at most that the most different texts have, from HOT_LEAST * SAMPLE texts on; all texts are counted."""
    texts = docs.where(F.col("text").isNotNull()).select("text", "salt")
    repeated = stored(texts.groupBy("salt").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(digest_of(F.col("salt")).alias("sha")), "repeated")
    rows, spread = repeated.count(), None
    if rows:
        spread = docs.sparkSession.sparkContext.broadcast(bloom_filter(repeated, rows))
        texts = texts.withColumn("sha", digest_of(F.col("salt")))
    forget(repeated)
    parts = -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // COUNT_BYTES)
    dealt = map_arrow(texts, _dealt_shingles(spread, parts), _DEALT)
    counted = map_arrow(dealt.repartition("part").sortWithinPartitions("part"), _counted_shingles(HOT_LEAST * SAMPLE), "token long, n long")
    counted = stored(counted.hint("rebalance"), "common")  # few rows from many tasks: few files
    least, total = 0, 0
    # Different counts are few: their histogram grows with the root of the shingles at most.
    for r in counted.groupBy("n").count().orderBy(F.desc("n")).collect():
        total += r["count"]
        if total > HOT_MOST:
            least = r.n + 1
            break
    hot = counted.where(F.col("n") >= least).select("token").toArrow().column(0).to_numpy()
    forget(counted)
    return np.sort(hot.astype(np.int64).view(np.uint64))


def key_count(n: int, hot: int) -> int:
    """How many keys a set of n shingles needs, of which so many are common.

    Of what two similar sets have besides common shingles, a share of (3/4 - hot / n) / (1 - hot / n)
    is shared at least, and KEYS keys suffice where that is 3/4. With n - ceil(3/4 n) + 1 keys two
    similar sets share one in any case.
    """
    every = n - -(-NUM * n // DEN) + 1
    odds = DEN * (n - hot) / n  # one over the share that may be different
    return every if odds <= 1 else min(every, int(np.ceil(KEYS * np.log(DEN) / np.log(odds) - 1e-9)))


def keys_of(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The keys of a set: its first shingles in the common order."""
    if not len(hot):
        return tokens[: key_count(len(tokens), 0)]
    known = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
    rare = tokens[~known]
    k = key_count(len(tokens), len(tokens) - len(rare))
    return rare[:k] if k <= len(rare) else np.concatenate([rare, tokens[known][: k - len(rare)]])


def _signatures(docs: DataFrame) -> DataFrame:
    """id, salt, n, class, the keys, the bitmap; no class for a text without words."""
    spread = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))
    schema = T.StructType([docs.schema["id"], T.StructField("salt", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("low", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())])

    def run(batches):
        release_encoders()
        for b in batches:
            sets = shingle_sets(*texts_of(b.column("text")))
            rows = [(len(s), _class_of(s), keys_of(s, spread.value).view(np.int64), bitmap(s, width_of(len(s))).tobytes()) if len(s) else (0, None, None, None) for s in sets]
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("salt"), *columns], names=schema.names)

    return map_arrow(docs, run, schema)


def _rows_by(batches, key: str):
    """Lists of rows with one key, from batches that are sorted by it."""

    def rows():
        for b in batches:
            yield from b.to_pylist()

    for _, own in groupby(rows(), key=lambda r: r[key]):
        yield list(own)


def _stars(names: list[bytes], groups: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(member, smallest member) for each member of a group but that one."""
    root: dict[int, bytes] = {}
    for name, g in zip(names, groups.tolist(), strict=True):
        root[g] = min(name, root.get(g, name))
    return [(name, root[g]) for name, g in zip(names, groups.tolist(), strict=True) if name != root[g]]


_EDGE = "a binary, b binary"


def _edge_batches(pairs):
    """Batches of at most 10,000 edges."""
    held = []
    for edges in pairs:
        held += edges
        if len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in held], pa.binary()) for k in (0, 1)], names=["a", "b"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in held], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _block_chains(batches):
    def chains():
        for rows in _rows_by(batches, "part"):
            sizes = np.array([r["n"] for r in rows], np.int64)
            near = np.array([r["near"] for r in rows], np.int64)
            groups = similar_groups([np.frombuffer(r["bits"], np.uint64) for r in rows], sizes, near, Groups(len(rows)), None, NUM, DEN)
            yield _stars([r["cls"] for r in rows], groups.flat())

    yield from _edge_batches(chains())


def _totals():
    return F.count(F.lit(1)).alias("members"), F.sum(F.col("n") + _ROW_BYTES).alias("bytes")


def _chains(classes: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """Links between classes that may be similar, from the signature trees of all blocks; scratch gets what is stored on the way."""
    keys = classes.select("cls", "n", F.explode("low").alias("token"))
    sums = keys.groupBy("token").agg(*_totals(), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    blocks = sums.where("members > 1").groupBy("members", "bytes", "x", "y").agg(F.min("token").alias("token")).select("token", "bytes")
    members = stored(keys.join(blocks, "token").select(F.xxhash64("token").alias("part"), "cls", "n", "bytes").hint("rebalance"), "members")
    scratch.append(members)
    large = members.where(F.col("bytes") > BLOCK_BYTES)
    whole = None
    small = members.where(F.col("bytes") <= BLOCK_BYTES).select("part", "cls")
    if not large.isEmpty():
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(_BAND)))
        dealt = stored(large.select(F.explode(F.array(F.xxhash64("part", band), F.xxhash64("part", band + 1))).alias("part"), "cls", "n"), "dealt")
        scratch.append(dealt)
        sums = dealt.groupBy("part").agg(*_totals(), F.min("cls").alias("head"))
        dealt = dealt.join(sums, "part").where("members > 1")
        small = small.unionByName(dealt.where(F.col("bytes") <= BLOCK_BYTES).select("part", "cls"))
        whole = dealt.where(F.col("bytes") > BLOCK_BYTES).select(F.col("cls").alias("a"), F.col("head").alias("b"))
    full = small.join(classes.select("cls", "n", F.col("low")[0].alias("near"), "bits"), "cls")
    chains = map_arrow(full.repartition("part").sortWithinPartitions("part"), _block_chains, _EDGE)
    return chains if whole is None else chains.unionByName(whole)


def _verifier(sets: list[np.ndarray]):
    sizes = np.array([len(s) for s in sets], np.int64)

    def verify(i: int, others: np.ndarray) -> np.ndarray:
        own = sets[i]
        theirs = np.concatenate([sets[j] for j in others])
        at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
        shared = np.add.reduceat((own[at] == theirs).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
        return DEN * shared >= NUM * (len(own) + sizes[others] - shared)

    return verify


def _settle(batches):
    """Links between similar classes of each part; classes with one label are linked already."""

    def links():
        for rows in _rows_by(batches, "part"):
            rows = list({r["cls"]: r for r in rows}.values())
            sets = [np.frombuffer(r["tokens"], np.uint64) for r in rows]
            groups = Groups(len(rows))
            first: dict[bytes, int] = {}
            for i, r in enumerate(rows):
                groups.join(first.setdefault(r["label"], i), i)
            sizes = np.array([len(s) for s in sets], np.int64)
            near = np.array([s[0] for s in sets], np.uint64)
            done = similar_groups([bitmap(s, width_of(len(s))) for s in sets], sizes, near, groups, _verifier(sets), NUM, DEN)
            yield sorted(set(_stars([r["label"] for r in rows], done.flat())))

    yield from _edge_batches(links())


def _settled(sets: DataFrame) -> DataFrame:
    return map_arrow(sets.select("part", "cls", "label", "tokens").repartition("part").sortWithinPartitions("part"), _settle, _EDGE)


def _sets(docs: DataFrame, members: DataFrame, rows: int) -> DataFrame:
    """members with the whole sets of their classes, taken from one document of each."""
    schema = T.StructType([*members.drop("rep").schema.fields, T.StructField("tokens", T.BinaryType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for b in batches:
            sets = shingle_sets(*texts_of(b.column("text")))
            own = b.column("cls").to_pylist()
            keep = [len(s) > 0 and _class_of(s) == c for s, c in zip(sets, own, strict=True)]
            tokens = pa.array([s.tobytes() for s, k in zip(sets, keep, strict=True) if k], pa.binary())
            left = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(left.column(c) for c in names), tokens], names=schema.names)

    left = members.withColumns({"__id": F.col("rep.id"), "__salt": F.col("rep.salt")}).drop("rep")
    # Most texts lie in no cluster: a filter of the wanted keys keeps them out of the shuffle.
    keys = left.select(digest_of(F.col("__id"), F.col("__salt")).alias("sha"))
    some = rows_that_may_match(docs, digest_of(F.col("id"), F.col("salt")), keys, rows, "wanted").where("wanted").drop("wanted")
    joined = some.join(left, some["id"].eqNullSafe(left["__id"]) & (some["salt"] == left["__salt"])).select("text", *names)
    return map_arrow(joined, run, schema)


def _part(*columns):
    return F.xxhash64(*columns)


def _links(docs: DataFrame, classes: DataFrame, chunk_tokens: int, scratch: list[DataFrame]) -> DataFrame:
    """(node, root) for classes that are linked with others; scratch gets what is stored on the way."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        scratch.append(stored(df, name))
        return scratch[-1]

    of_blocks: list[DataFrame] = []
    clusters = kept(components(_chains(classes, of_blocks), of_blocks), "clusters")
    forget(*of_blocks)
    members = clusters.select(F.col("node").alias("cls"), F.col("root").alias("cluster")).join(classes.select("cls", "n", "rep"), "cls")
    totals = kept(members.groupBy("cluster").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("weight")), "totals")
    chunks = totals.select("cluster", "weight", F.ceil(F.col("tokens") / F.lit(chunk_tokens)).cast("long").alias("chunks"))
    members = join_hot(members, chunks, "cluster", "weight", classes.count())
    members = kept(members.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks"))), "members")
    sets = _sets(docs, members, members.count()).withColumn("label", F.col("cls"))
    if totals.where(F.col("tokens") > chunk_tokens).isEmpty():
        return components(_settled(sets.withColumn("part", _part("cluster", "chunk"))), scratch)
    sets = kept(sets, "sets")
    links = kept(_settled(sets.withColumn("part", _part("cluster", "chunk"))), "links1")
    large = sets.where("chunks > 1")
    # One class of each group found so far, dealt into as few parts as their sizes need.
    inner = components(links, scratch)
    heads = large.join(inner.where("node != root").select(F.col("node").alias("cls")), "cls", "left_anti")
    few = kept(heads.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(chunk_tokens)).cast("long").alias("parts"), F.count(F.lit(1)).alias("weight")), "heads")
    heads = join_hot(heads, few, "cluster", "weight", classes.count()).withColumn("part", _part("cluster", F.pmod(F.xxhash64("cls", F.lit(2)), F.col("parts"))))
    links = kept(links.unionByName(_settled(heads)), "links2")
    # Classes outside the cluster's largest group, against all others of the cluster.
    now = components(links, scratch).select(F.col("node").alias("cls"), F.col("root").alias("label"))
    large = kept(large.drop("label").join(now, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "large")
    counts = large.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"))
    tops = counts.groupBy("cluster").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("tokens").alias("all"), F.sum("size").alias("weight"), F.max(F.struct("size", "label", "tokens"))["tokens"].alias("inside"))
    tops = kept(tops.select("cluster", "weight", F.col("top.label").alias("main"), F.ceil((F.col("all") - F.col("inside")) / F.lit(chunk_tokens)).cast("long").alias("sides")), "tops")
    large = join_hot(large, tops, "cluster", "weight", classes.count()).where("sides > 0")
    every = large.withColumn("side", F.explode(F.expr("sequence(0L, sides - 1)")))
    minor = large.where(F.col("label") != F.col("main")).withColumn("side", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("sides"))).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
    pairs = every.unionByName(minor).withColumn("part", _part("cluster", "chunk", "side"))
    return components(links.unionByName(_settled(pairs)), scratch)


def _labelled(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """id, salt, n, root (a class; null without words) and component_id for each row of docs (id, text, salt)."""
    marks = stored(_signatures(docs), "signatures")
    rows = marks.where(F.col("cls").isNotNull())
    classes = rows.groupBy("cls").agg(F.first("n").alias("n"), F.min("id").alias("least"), F.max(F.struct("id", "salt")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("low").alias("low"), F.first("bits").alias("bits"))
    classes = stored(classes, "classes")
    scratch: list[DataFrame] = []
    links = _links(docs, classes, chunk_tokens, scratch).where("node != root")
    rooted = classes.select("cls", "least", "copies").join(links.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("weight"))
    named = join_hot(rooted, least, "root", "weight", classes.count()).select("cls", "root", "component_id", F.col("copies").alias("weight"))
    named = stored(named, "named")
    forget(classes, *scratch)
    linked = join_hot(rows.select("id", "salt", "n", "cls"), named, "cls", "weight", marks.count())
    alone = marks.where(F.col("cls").isNull()).select("id", "salt", "n", F.lit(None).cast("binary").alias("root"), F.col("id").alias("component_id"))
    return linked.select("id", "salt", "n", "root", "component_id").unionByName(alone)


def _salted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("salt"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) for each row of df.

    A-Z are lower-cased; words are runs without ASCII white space; a set holds the distinct shingles
    of SHINGLE words, a shorter text its whole sequence. Whole texts are read, however long. Two rows are linked when their sets'
    similarity is 0.75 or more. A null or empty text, or one without words, has an empty set and is
    linked with nothing: its component_id is its own id. Null ids don't serve as component_id unless
    a component has no others. Repeated rows each have a row. An empty table gives an empty result.
    Other columns are not read.
    """
    out = _labelled(_salted(df, id_col, text_col), chunk_tokens)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def near_duplicate_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The rows of df that stay, with all their columns: of each component the one with the smallest id.

    A null id comes after all others. Rows without words (null, empty or blank texts) all stay. Rows equal in
    id and text are one document and stay, or go, together. Whole texts are compared, however long. An
    empty table gives no rows. Columns of any name are carried along.
    """
    named = stored(_labelled(_salted(df, id_col, text_col), chunk_tokens), "labelled")
    rows = named.where(F.col("root").isNotNull())
    best = F.struct(F.col("id").isNull().alias("last"), "id", "salt")
    first = rows.groupBy("root").agg(F.min(best).alias("first"), F.count(F.lit(1)).alias("weight"))
    # Those that go are few: only rows a filter takes for one of them are shuffled, the rest pass straight through.
    gone = join_hot(rows.select("root", "id", "salt"), first, "root", "weight", named.count()).where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("salt") == F.col("first.salt"))))
    p = fresh_prefix(df)
    gone = stored(gone.select(F.col("id").alias(f"{p}id"), F.col("salt").alias(f"{p}salt")).distinct(), "gone")
    keys = gone.select(digest_of(F.col(f"{p}id"), F.col(f"{p}salt")).alias("sha"))
    marked = rows_that_may_match(df, digest_of(F.col(id_col), F.xxhash64(text_col)), keys, gone.count(), f"{p}may")
    doubtful = marked.where(F.col(f"{p}may")).drop(f"{p}may").withColumn(f"{p}hash", F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}hash") == F.col(f"{p}salt"))
    return marked.where(~F.col(f"{p}may")).drop(f"{p}may").unionByName(doubtful.join(gone, same, "left_anti").drop(f"{p}hash"))
