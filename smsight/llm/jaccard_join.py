"""Near copies by a grouped prefix join on word shingles, exact for a Jaccard threshold given in per cent.

1. Shingles become 64-bit codes whose order is rarity: those above a count come last, by that count, all others by hash.
   Counts are taken over all documents, on 32-bit fingerprints that tasks add up before they are dealt out by range. The
   order only decides how much is compared, never what links.
2. Equal sets are one class. Classes with identical prefixes and size are one group; only a group's prefix is indexed.
   A set of n shingles has a prefix of n - ceil(t n) + 1, without which no partner can reach t.
3. Groups that share a prefix code are candidates if the lengths allow it and enough codes are left after both positions;
   where a group is one class, its parity bitmap must differ in no more bits than two linked sets may differ in codes.
4. Candidates are first compared with one leader for each code and group, which joins near copies into stars. What is left
   are codes whose groups still lie in several components: there, members outside the largest component of the code are
   compared with all others, which is exact, as links inside a component can't change it.
5. Groups are expanded to their classes, and every pair is verified on the whole texts.

So a large group of copies costs comparisons in proportion to its members, not to its pairs, and nothing is capped.

Defined results: a null or empty text, or one of white space, has no shingles and is linked with nothing (its component is
its own id); a text with fewer words than a shingle has one shingle; repeated rows are copies; a null id never becomes a
component id unless all ids of the component are null. Sets are compared by 64-bit hashes, classes by 128-bit digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from smsight.llm.components import components
from smsight.llm.frames import Scratch, binary, by_slices, lists
from smsight.llm.words import SPACED, Words, mix, shingles

FREQUENT_FROM = 16
MOST_FREQUENT = 1 << 20  # ranks fit into 20 bits, 12 MB are broadcast
PARITY_BITS = 256
_TOP = np.uint64(1 << 63)


def _distinct(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """63-bit shingle hashes of each text, and where each text's begin."""
    words = Words(column, SPACED)
    value, begins = shingles(words.hashes(), words.first, size)
    return value >> np.uint64(1), begins


def frequent_codes(texts: DataFrame, size: int, scratch: Scratch, from_count: int = FREQUENT_FROM, most: int = MOST_FREQUENT) -> np.ndarray:
    """Fingerprints of the most frequent shingles, rarer ones first."""
    spark = texts.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        value, begins = _distinct(batch.column(0), size)
        if not len(value):
            return None
        print_, n = np.unique((value >> np.uint64(31)).astype(np.uint32), return_counts=True)
        n = np.minimum(n, 65535).astype(np.uint16)
        part = (print_.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)
        at = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(at))
        return pa.record_batch({
            "part": pa.array(some, pa.int32()), "prints": binary([print_[at[i]:at[i + 1]].tobytes() for i in some]),
            "counts": binary([n[at[i]:at[i + 1]].tobytes() for i in some])})

    def tally(batches):
        prints, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        held, size_held = [], 0

        def merged():
            p = np.concatenate([prints, *(x for x, _ in held)])
            n = np.concatenate([counts, *(y for _, y in held)])
            order = np.argsort(p, kind="stable")
            p, n = p[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
            return p[first], (np.add.reduceat(n, first) if len(p) else n)

        for batch in batches:
            for p, n in zip(batch.column("prints").to_pylist(), batch.column("counts").to_pylist()):
                held.append((np.frombuffer(p, np.uint32), np.frombuffer(n, np.uint16).astype(np.int64)))
                size_held += len(p)
                if size_held > 32 << 20:
                    prints, counts = merged()
                    held, size_held = [], 0
        prints, counts = merged()
        many = counts > from_count
        if many.any():
            yield pa.record_batch({"print": pa.array(prints[many].astype(np.int64)), "n": pa.array(counts[many])})

    dealt = by_slices(texts, "text", fingerprints, "part int, prints binary, counts binary").repartition(parts, "part")
    counted = scratch.keep(dealt.mapInArrow(tally, "print bigint, n bigint"), "frequent")
    scale = F.floor(F.log2("n")).cast("int").alias("scale")
    least, room = None, most
    for row in counted.groupBy(scale).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("scale")).collect():
        if row.n > room:
            break
        least, room = row.scale, room - row.n
    if least is None:
        return np.zeros(0, np.uint32)
    chosen = counted.where(F.col("n") >= 2 ** least).toPandas().sort_values(["n", "print"])
    return chosen["print"].to_numpy().astype(np.uint32)


class Order:
    """Codes of shingles: rare ones keep their hash, frequent ones come after them by rank."""

    def __init__(self, frequent: np.ndarray):
        order = np.argsort(frequent)
        self.prints, self.rank = frequent[order], order.astype(np.uint64)
        self.bitmap = np.zeros(1 << 24, bool)
        self.bitmap[self.prints >> np.uint32(8)] = True

    def codes(self, value: np.ndarray) -> np.ndarray:
        print_ = (value >> np.uint64(31)).astype(np.uint32)
        at = np.flatnonzero(self.bitmap[print_ >> np.uint32(8)])
        number = np.searchsorted(self.prints, print_[at])
        number[number == len(self.prints)] = 0
        if len(at):
            same = self.prints[number] == print_[at]
            at, number = at[same], number[same]
        out = value.copy()
        out[at] = _TOP | (self.rank[number] << np.uint64(43)) | (value[at] & np.uint64((1 << 43) - 1))
        return out


def signatures(texts: DataFrame, order, size: int, percent: int) -> DataFrame:
    """(id, tkey, n, digest, gkey, prefix, parity) of every row of ``texts`` (id, tkey, text).

    The parity is a bitmap to which every code adds one bit modulo two, so two of them differ in at most as many bits as
    their sets differ in codes.
    """
    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, begins = _distinct(batch.column("text"), size)
        code = order.value.codes(value)
        n, digest, gkey, prefix, ends = [], [], [], [], [0]
        parity = np.zeros((batch.num_rows, PARITY_BITS), np.uint8)
        for i in range(batch.num_rows):
            own = np.unique(code[begins[i]:begins[i + 1]])
            n.append(len(own))
            parity[i] = np.bincount((mix(own) & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
            head = own[:len(own) - (percent * len(own) + 99) // 100 + 1] if len(own) else own
            prefix.append(head)
            ends.append(ends[-1] + len(head))
            digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            gkey.append(int.from_bytes(hashlib.blake2b(head.tobytes(), digest_size=8).digest(), "little", signed=True))
        flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
        return pa.record_batch({
            "id": batch.column("id"), "tkey": batch.column("tkey"), "n": pa.array(n, pa.int32()), "digest": binary(digest),
            "gkey": pa.array(gkey, pa.int64()), "prefix": lists(flat.view(np.int64), ends, pa.int64()),
            "parity": lists(np.packbits(parity, axis=1).reshape(-1).view(np.int64),
                            np.arange(batch.num_rows + 1) * (PARITY_BITS // 64), pa.int64())})

    kind = texts.schema["id"].dataType.simpleString()
    return by_slices(texts, "text", sign, f"id {kind}, tkey bigint, n int, digest binary, gkey bigint, prefix array<bigint>, parity array<bigint>")


def _enough(percent: int, a: str, b: str):
    """Whether two sets of these sizes can reach the threshold."""
    small, large = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return 100 * small >= percent * large


def _room(percent: int, a: str, b: str):
    """Whether enough codes are left if this is the first common one: holds for a linked pair at its first common code."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return (100 + percent) * left >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _near(percent: int, a: Column, b: Column, sizes: Column) -> Column:
    """Whether sets with these parities can be close enough; true where one is unknown."""
    apart = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PARITY_BITS // 64)), F.lit(0))
    return a.isNull() | b.isNull() | ((100 + percent) * apart <= (100 - percent) * sizes)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: digests) whose sets link. texts: (digest, text)."""
    def check(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sides = [_distinct(batch.column(c), size) for c in ("text_a", "text_b")]
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.unique(v[at[i]:at[i + 1]]) for v, at in sides)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b"))
    return by_slices(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"), "text_a", check, "a binary, b binary")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
                       keys: bool = False) -> DataFrame:
    """(id, ``n_shingles``, ``component_id``) for every row: the component of documents whose sets reach the threshold.

    With ``keys`` also ``tkey``, the hash of the text, and ``first``: whether id and text are those of the one row that leads
    the component, the least id (null after all others), then the least hash. It is null for rows without shingles.
    """
    if not 1 <= percent <= 100 or size < 1:
        raise ValueError("percent lies in 1..100, a shingle has at least one word")
    spark = documents.sparkSession
    scratch, result = Scratch(spark), Scratch(spark)
    keep = scratch.keep
    texts = documents.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tkey"), F.col(text_col).cast("string").alias("text"))
    order = spark.sparkContext.broadcast(Order(frequent_codes(texts.select("text"), size, scratch)))
    rows = keep(signatures(texts, order, size, percent), "signatures")
    classes = keep(
        rows.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tkey")).alias("of"), F.min("id").alias("least"),
                                                  F.min("n").alias("n"), F.min("gkey").alias("gkey"),
                                                  F.first("parity").alias("parity")), "classes")

    def linked(pairs: DataFrame) -> DataFrame:
        """Verify pairs of classes on the texts of those classes only."""
        part = Scratch(spark)
        pairs = part.keep(_ordered(pairs), "pairs")
        asked = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
        chosen = part.keep(classes.join(asked, "digest", "left_semi").select("digest", "of.id", "of.tkey"), "chosen")
        found = texts.join(chosen.hint("merge"), texts.id.eqNullSafe(chosen.id) & (texts.tkey == chosen.tkey)).select("digest", "text")
        links = keep(verified(pairs, part.keep(found, "candidates"), size, percent), "links")
        part.drop()
        return links

    groups = rows.where("n > 0").groupBy("gkey", "n").agg(F.first("prefix").alias("prefix"))
    entries = groups.select("gkey", "n", "prefix", F.posexplode("prefix").alias("pos", "code")).withColumn(
        "last", F.when(F.col("pos") > 0, F.get("prefix", F.col("pos") - 1))).drop("prefix")
    # codes that are not frequent have few rows each, so a window over them is safe; frequent ones need no count
    alone = F.count(F.lit(1)).over(Window.partitionBy("code"))
    index = keep(
        entries.where("code >= 0").withColumn("k", alone).where("k > 1").drop("k").unionByName(entries.where("code < 0")), "index")

    member = classes.select("gkey", "n", "digest", "parity")
    several = member.groupBy("gkey", "n").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("digest", "parity")).alias("first"))

    # stars: every class with the first of its group, the first of every group with the leader of its code
    # the leader has the fewest rarer codes, so of copies it is the one with the fewest changes
    lead = index.groupBy("code").agg(F.min(F.struct("pos", "gkey", "n")).alias("lead")).select("code", "lead.*")
    star = (index.alias("x").join(lead.alias("y"), "code")
            .where((F.col("x.gkey") != F.col("y.gkey")) & _enough(percent, "x", "y") & _room(percent, "x", "y"))
            .select(F.col("x.gkey").alias("gkey"), F.col("x.n").alias("n"), F.col("y.gkey").alias("g2"), F.col("y.n").alias("n2")).distinct())
    one = several.select("gkey", "n", F.col("first.digest").alias("a"), F.col("first.parity").alias("pa"))
    two = several.select(F.col("gkey").alias("g2"), F.col("n").alias("n2"), F.col("first.digest").alias("b"), F.col("first.parity").alias("pb"))
    near = _near(percent, F.col("pa"), F.col("pb"), F.col("n") + F.col("n2"))
    pairs = star.join(one, ["gkey", "n"]).join(two, ["g2", "n2"]).where(near).select("a", "b").unionByName(
        member.join(several.where("k > 1"), ["gkey", "n"]).where(_near(percent, F.col("parity"), F.col("first.parity"), 2 * F.col("n")))
        .select(F.col("digest").alias("a"), F.col("first.digest").alias("b")))
    links = linked(pairs)

    # what is left: codes, and groups, whose classes lie in several components
    label = components(links, keep)
    placed = keep(member.join(label, member.digest == label.node, "left")
                     .select("gkey", "n", "digest", "parity", F.coalesce("label", "digest").alias("label")), "placed")
    number = F.xxhash64("label")  # labels are only compared here
    of_group = placed.groupBy("gkey", "n").agg(
        F.min(number).alias("low"), F.max(number).alias("high"),
        F.when(F.count(F.lit(1)) == 1, F.first("parity")).alias("parity"))  # of a group of one class
    spread = index.join(of_group, ["gkey", "n"])
    open_codes = spread.groupBy("code").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("code")
    open_rows = keep(spread.join(open_codes, "code"), "open")
    sizes = open_rows.groupBy("code", "low").agg(F.count(F.lit(1)).alias("k"))
    major = sizes.groupBy("code").agg(F.max_by("low", F.struct("k", "low")).alias("major"))
    minor = open_rows.join(major, "code").where((F.col("low") != F.col("high")) | (F.col("low") != F.col("major")))
    rest = (minor.alias("x").join(open_rows.alias("y"), "code")
            .where(_enough(percent, "x", "y") & _room(percent, "x", "y")
                   & _near(percent, F.col("x.parity"), F.col("y.parity"), F.col("x.n") + F.col("y.n"))
                   & ((F.col("x.low") != F.col("y.low")) | (F.col("x.high") != F.col("y.high")) | (F.col("x.low") != F.col("x.high")))
                   & ~F.coalesce(F.col("x.last") == F.col("y.last"), F.lit(False)))  # else the pair has been made at the code before
            .select(F.col("x.gkey").alias("gkey"), F.col("x.n").alias("n"), F.col("y.gkey").alias("g2"), F.col("y.n").alias("n2"))
            .unionByName(of_group.where("low != high").select("gkey", "n", F.col("gkey").alias("g2"), F.col("n").alias("n2"))).distinct())
    x = placed.select("gkey", "n", F.col("digest").alias("a"), F.col("label").alias("label_a"), F.col("parity").alias("pa"))
    y = placed.select(F.col("gkey").alias("g2"), F.col("n").alias("n2"), F.col("digest").alias("b"), F.col("label").alias("label_b"), F.col("parity").alias("pb"))
    pairs = rest.join(x, ["gkey", "n"]).join(y, ["g2", "n2"]).where(
        (F.col("label_a") != F.col("label_b")) & near).select("a", "b")
    links = links.unionByName(linked(pairs))

    label = components(links, keep)
    named = classes.select("digest", "least", "of").join(label, F.col("digest") == F.col("node"), "left").select(
        "digest", "least", "of", F.coalesce("label", "digest").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.min("of").alias("lead"))
    known = named.join(least, "label").select("digest", "component_id", "lead")
    leads = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("tkey") == F.col("lead.tkey"))
    out = result.keep(rows.select("id", "tkey", "n", "digest").join(known, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        *([F.col("tkey"), F.when(F.col("n") > 0, leads).alias("first")] if keys else [])), "components")
    scratch.drop()
    return out
