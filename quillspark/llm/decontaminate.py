"""Benchmark decontamination by templates.

Texts are put in a canonical form word by word: numbers, units and names become typed placeholders, other words lose case
and punctuation at their ends. Hashes of windows over these templates join benchmark items with documents; what stood in the
placeholders comes along, and a document counts as holding an item if the values that it puts in the item's slots are
consistent (each value of the item always becomes the same one) over windows that cover enough of the item. So questions
are found again after their names or numbers have been exchanged, while texts that merely share a form are not.

What items share with each other says little about any of them: a word counts as much as the rarest window around it, a
window that many templates have being worth its share, and windows of very many bring no document and item together.

The benchmark's window hashes are the stated query set: sorted blocks of them, of bounded size, go to where the documents
are read, so that only windows that match are shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, texts, unused, written
from .words import mix, span_hashes

WINDOW = 8
#: Words of a window that aren't placeholders, at least (fewer only in items shorter than a window); windows with fewer are
#: matched by their plain words.
LITERALS = 5
#: Words besides placeholders of a window that counts only where the whole item is matched.
WEAK_LITERALS = 3
#: Templates of the benchmark that a window may be in for it to bring documents and items together, unless an item can be
#: covered by such windows alone.
COMMON = 8
#: Hashes of benchmark windows that are broadcast at once.
BLOCK = 1_000_000
#: Bytes of text whose windows are worked out at once; they take many times the room.
AT_ONCE = 1 << 20
#: Words over which an occurrence of an item may be scattered: so many times the item's, and so many at least.
SPREAD, LEAST_SPREAD = 4, 64
# Words that count as numbers and as units.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km metre metres meter meters kilometre kilometres kilometer kilometers inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees watt watts volt volts joule joules newton newtons".split()

_CORE = np.array([chr(b).isalnum() and b < 0x80 or b >= 0x80 for b in range(256)])
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_NUMERIC = _DIGIT | np.isin(np.arange(256), [ord(c) for c in ".,:/-"])
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?:"])
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
LITERAL, NUMBER, UNIT, NAME = range(4)
TYPED, BLIND, PLAIN, WEAK = range(4)
_SLOTS = mix(np.arange(1, 5, dtype=np.uint64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _hashed(listed: list[str]) -> np.ndarray:
    joined = " ".join(listed).encode()
    ends = np.cumsum([len(w) + 1 for w in listed]) - 1
    return np.sort(span_hashes(np.frombuffer(joined + b" ", np.uint8), ends - np.array([len(w) for w in listed]), ends))


_NUMBER_WORDS, _UNIT_WORDS = _hashed(NUMBERS), _hashed(UNITS)


class Templates:
    """The canonical words of several texts: hashes, kinds, where they stand, and each text's first word."""

    def __init__(self, batch: list[bytes | None]):
        batch = [t or b"" for t in batch]
        self.joined = b"\n".join(batch) + b"\n"
        data = np.frombuffer(self.joined, np.uint8)
        lower = np.frombuffer(self.joined.translate(_LOWER), np.uint8)
        space = _SPACE[data]
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        core = np.flatnonzero(_CORE[data])
        first, last = np.searchsorted(core, starts), np.searchsorted(core, ends) - 1
        some = last >= first
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in batch])])
        # a sentence starts after a stop, at a line's start and at the text's
        begins = np.ones(len(starts), bool)
        if len(starts) > 1:
            begins[1:] = _STOP[data[ends[:-1] - 1]] | (data[starts[1:] - 1] == 0x0A)
        starts, ends, begins = core[first[some]], core[last[some]] + 1, begins[some]
        self.starts, self.ends = starts, ends
        self.hashes = span_hashes(lower, starts, ends)
        self.kinds = np.zeros(len(starts), np.uint8)
        capital = _UPPER[data[starts]] & (ends - starts > 1)
        self.kinds[capital & ~begins] = NAME
        self.kinds[_among(self.hashes, _UNIT_WORDS)] = UNIT
        run = np.concatenate([[0], np.cumsum(_NUMERIC[data])])
        self.kinds[(run[ends] - run[starts] == ends - starts) & _DIGIT[data[starts]] | _among(self.hashes, _NUMBER_WORDS)] = NUMBER
        self.opens = capital & begins & (self.kinds == LITERAL)
        self.plain = self.hashes
        self.hashes = np.where(self.kinds == LITERAL, self.plain, _SLOTS[self.kinds])
        # names as the literals that they are in lower case: the same for a word wherever it stands and however it is cased
        self.blind = np.where(self.kinds == NAME, self.plain, self.hashes)
        self.firsts = np.searchsorted(starts, at)
        self.text_of = np.repeat(np.arange(len(batch)), np.diff(self.firsts))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the windows of `size` words, the word at which each starts, the window's form, and whether its first word
        is a placeholder beside those that are always. Forms: TYPED, of the template or of the template whose first word isn't
        taken for a name (an item's first word isn't); BLIND, of that without names; PLAIN, instead of the last where there
        are too few literals, of the plain words, which only exact copies share; WEAK, of a template with few literals, or of
        one whose first word is taken for a name although it opens a sentence."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        whole = self.text_of[:n] == self.text_of[size - 1 :]
        least = LITERALS if size == WINDOW else math.ceil(size / 2)
        among = lambda which: np.concatenate([[0], np.cumsum(which)])
        literal, name = among(self.kinds == LITERAL), among(self.kinds == NAME)
        literals, names = literal[size:] - literal[:-size], name[size:] - name[:-size]
        first = self.kinds[:n] == NAME
        total = np.full(n, size, np.uint64)
        for i in range(size):
            total = total * _STEP + self.hashes[i : i + n]
        typed = np.flatnonzero(whole & (literals >= least))
        begun = np.flatnonzero(whole & first & (names > 1) & (literals + 1 >= least))
        blind = np.flatnonzero(whole & (names > 0) & (literals + names >= least))
        plain = np.flatnonzero(whole & (literals + names < least))
        weak = np.flatnonzero(whole & (literals < least) & (literals >= WEAK_LITERALS))
        alone = np.append(self.kinds[1:] != NAME, True)[:n]
        named = np.flatnonzero(whole & self.opens[:n] & alone & (literals - 1 >= min(least, WEAK_LITERALS)))
        power = _STEP ** np.uint64(size - 1)
        of_begun = total[begun] + (self.plain[begun] - self.hashes[begun]) * power
        of_named = total[named] + (_SLOTS[NAME] - self.hashes[named]) * power
        at = [typed, begun, blind, plain, weak, named]
        sizes = list(map(len, at))
        form = np.repeat(np.array([TYPED, TYPED, BLIND, PLAIN, WEAK, WEAK], np.int32), sizes)
        hashes = [mix(total[typed]), mix(of_begun), self.run(self.blind, blind, size), self.run(self.plain, plain, size), mix(total[weak]), mix(of_named)]
        return np.concatenate(hashes), np.concatenate(at), form, np.repeat(np.arange(6) == 5, sizes)

    @staticmethod
    def run(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the windows that start at these words."""
        total = np.full(len(at), size, np.uint64)
        for i in range(size):
            total = total * _STEP + hashes[at + i]
        return mix(total)

    def signs(self, i: int) -> tuple[int, int]:
        """Hashes of all of the text's template, and of that without names."""
        return tuple(xxhash.xxh3_64_intdigest(x[self.firsts[i] : self.firsts[i + 1]].tobytes()) >> 1 for x in (self.hashes, self.blind))

    def slots(self, at: int, size: int) -> list[int]:
        """Which words of the window are placeholders."""
        return np.flatnonzero(self.kinds[at : at + size] != LITERAL).tolist()

    def words(self, at: int, size: int) -> list[str]:
        """The window's words, lower-cased."""
        return [self.joined[self.starts[i] : self.ends[i]].decode(errors="replace").lower() for i in range(at, at + size)]


def _among(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted list."""
    at = np.minimum(np.searchsorted(listed, x), max(0, len(listed) - 1))
    return listed[at] == x if len(listed) else np.zeros(len(x), bool)


class _Block:
    """A sorted block of hashes with a table of bits before it, as most windows aren't in it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def has(self, x: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[(x & np.uint64((1 << 22) - 1)).astype(np.int64)])
        return maybe[_among(x[maybe], self.hashes)]


_FOUND = "id bigint, size int, hash bigint, form int, plain bigint, at int, words array<string>, slots array<int>, n_words int"


def _rows(t: Templates, ids: list, size: int, hashes: np.ndarray, at: np.ndarray, form: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    of = t.text_of[at] if len(at) else at
    n = np.diff(t.firsts)
    return pa.record_batch({"id": pa.array([ids[i] for i in of], pa.int64()), "size": pa.array([size] * len(at), pa.int32()), "hash": pa.array(hashes.view(np.int64), pa.int64()), "form": pa.array(form, pa.int32()), "plain": pa.array(t.run(t.plain, at, size).view(np.int64), pa.int64()), "at": pa.array(at - t.firsts[of], pa.int32()), "words": pa.array([t.words(i, size) for i in at.tolist()], pa.list_(pa.string())), "slots": pa.array([[0] * f + t.slots(i, size) for i, f in zip(at.tolist(), first.tolist())], pa.list_(pa.int32())), "n_words": pa.array(n[of], pa.int32())})


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = 0.5) -> DataFrame:
    """One row per pair of a document and a benchmark item that it holds: id, item, n_windows (matched windows of the item
    with consistent slots), coverage (share of the item's words in them, at least `coverage`, each word weighed by the rarest
    window of the item around it: 1 over the benchmark's templates that have the window), reparameterised (whether a slot's
    value differs from the item's), n_items (items with the item's template). Of several occurrences of the item in the
    document, each with values of its own, the one that covers most counts; what stands further apart than SPREAD times the
    item's length isn't one occurrence. So documents that hold only what many items have in common, as an instruction, hold
    none of them, and of a passage that is in many items each counts for its share.

    Of items that differ only in what stands in their slots, the smallest id stands for all; another one is reported where
    the document has its own values. So a template of many items doesn't give a row for each item and document.

    Items shorter than a window are matched as one window. Windows with fewer than LITERALS words that aren't placeholders
    (short items: fewer than half) say too little as templates: they are matched by their plain words, so that exact copies
    of items dense in numbers, units or names are found. As templates they count only with WEAK_LITERALS such words or more,
    and where all of the item's words are matched in one place; so do those whose first word opens a sentence with a capital
    and is taken for a name. Every window is matched without regard
    to case as well, with names as literals, since only case and the start of a sentence or line tell names from other words:
    copies in other case or wrapped otherwise are found where they keep the item's names. Slots' values are compared without
    case. Null or empty texts and items, and items without words, match
    nothing; rows with a null id take no part. Repeated rows give one pair; of rows with one id each adds its windows. Equal
    items are each reported. Empty tables give an empty result; other columns are ignored, so that names cannot clash. ids
    must be integers. Texts are searched whole.
    """
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    plain = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def index(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        t, ids = Templates(texts(batch, "text")), batch.column("id").to_pylist()
        out, n = [], np.diff(t.firsts)
        for size in {min(WINDOW, int(x)) for x in n if x}:
            hashes, at, form, first = t.windows(size)
            own = n[t.text_of[at]] if len(at) else at
            some = (own >= WINDOW) if size == WINDOW else (own == size)
            rows = _rows(t, ids, size, hashes[some], at[some], form[some], first[some])
            signs = [t.signs(int(i)) for i in (t.text_of[at[some]] if len(at) else ())]
            out.append(pa.record_batch({**dict(zip(rows.schema.names, rows.columns)), "template": pa.array([x for x, _ in signs], pa.int64()), "blind": pa.array([y for _, y in signs], pa.int64())}))
        return out

    entries = written(map_slices(items, "text", index, _FOUND + ", template bigint, blind bigint"), "benchmark-windows")
    sizes = sorted(r["size"] for r in entries.select("size").distinct().collect())
    total = entries.select("hash").distinct().count()
    found = None
    for b in range(max(1, math.ceil(total / BLOCK))):
        part = entries.filter(F.pmod("hash", F.lit(max(1, math.ceil(total / BLOCK)))) == b).select("hash").distinct()
        block = docs.sparkSession.sparkContext.broadcast(_Block(np.array([r["hash"] for r in part.collect()], np.int64).view(np.uint64)))

        def match(batch: pa.RecordBatch, block=block) -> list[pa.RecordBatch]:
            t, ids = Templates(texts(batch, "text")), batch.column("id").to_pylist()
            out = []
            for size in sizes:
                hashes, at, form, first = t.windows(size)
                some = block.value.has(hashes)
                out.append(_rows(t, ids, size, hashes[some], at[some], form[some], first[some]))
            return out

        hits = map_slices(plain, "text", match, _FOUND, AT_ONCE)
        found = hits if found is None else found.union(hits)

    # items of one template: the first stands for all of them, unless a window has the very words of another
    found = written(found.select("id", "size", "hash", "plain", "at", "words").distinct(), "matched-windows")
    first = lambda c: entries.groupBy(c).agg(F.min("id").alias(f"first_{c}"), F.count_distinct("id").alias(f"n_{c}"))
    stands = F.when(F.col("form") == TYPED, F.col("id") == F.col("first_template")).when(F.col("form") == BLIND, F.col("id") == F.col("first_blind")).otherwise(F.lit(True))
    # how many templates have each window, and what the item's words are worth by that
    entries = written(entries.join(entries.groupBy("size", "hash").agg(F.count_distinct("template").alias("df")), ["size", "hash"]), "weighed-windows")
    word = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("word")
    words = entries.select("id", word, (1 / F.col("df")).alias("w"), F.when(F.col("df") > COMMON, 1 / F.col("df")).alias("c")).groupBy("id", "word").agg(F.max("w").alias("w"), F.max("c").alias("c"))
    weights = words.groupBy("id").agg(F.sum("w").alias("weight"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("in_common"))
    mine = entries.join(first("template"), "template").join(first("blind"), "blind").join(weights, "id")
    meets = (F.col("df") <= COMMON) | (F.col("in_common") >= coverage * F.col("weight"))
    mine = mine.select(F.col("id").alias("item"), "size", "hash", "form", "df", "weight", meets.alias("meets"), "plain", stands.alias("stands"), F.col("at").alias("item_at"), F.col("words").alias("item_words"), F.col("slots").alias("places"), "n_words", F.col("n_template").alias("n_items"))
    mine = written(mine.distinct(), "benchmark-items")
    # the item tells which words are slots; in a window found by its plain words, they have the item's values
    at_slots = lambda words: F.transform("places", lambda i: F.get(words, i))

    def met(held: DataFrame, windows: DataFrame, *key: str) -> DataFrame:
        of_all = held.drop("plain").distinct().join(windows.filter("stands").drop("plain"), [*key, "size", "hash"])
        of_one = held.join(windows.filter("NOT stands"), [*key, "size", "hash", "plain"]).drop("plain")
        return of_all.unionByName(of_one)

    pairs = written(met(found, mine.filter("meets")).drop("meets"), "pairs")
    # windows of very many templates are looked at only in documents and items that have met
    common = mine.filter("NOT meets").drop("meets")
    if not common.isEmpty():
        known = written(pairs.select("id", "item").distinct().join(common, "item"), "common-windows")
        pairs = pairs.unionByName(met(found, known, "id"))
    pairs = pairs.withColumn("slots", at_slots("words")).withColumn("item_slots", at_slots("item_words"))
    # what lies close together, in stretches that overlap by half
    spread = F.greatest(F.lit(LEAST_SPREAD), SPREAD * F.col("n_words"))
    shift = F.col("at") - F.col("item_at")
    near = F.explode(F.array(F.floor(shift / spread) * 2, F.floor((shift + spread / 2) / spread) * 2 + 1))
    each = pairs.withColumn("near", near).groupBy("id", "item", "near").agg(F.first("n_words").alias("n_words"), F.first("weight").alias("weight"), F.first("n_items").alias("n_items"), F.collect_list(F.struct("size", "at", "item_at", "slots", "item_slots", "df", (F.col("form") == WEAK).alias("weak"))).alias("windows"))

    def judge(batches):
        for batch in batches:
            out = {"id": [], "item": [], "n_windows": [], "coverage": [], "reparameterised": [], "n_items": []}
            for doc, item, n, weight, n_items, windows in zip(*(batch.column(c).to_pylist() for c in ("id", "item", "n_words", "weight", "n_items", "windows"))):
                used, share, other = best_occurrence(n, windows, weight)
                if share >= coverage:
                    for name, x in zip(out, (doc, item, used, share, other, n_items)):
                        out[name].append(x)
            yield pa.record_batch({"id": pa.array(out["id"], pa.int64()), "item": pa.array(out["item"], pa.int64()), "n_windows": pa.array(out["n_windows"], pa.int64()), "coverage": pa.array(out["coverage"], pa.float64()), "reparameterised": pa.array(out["reparameterised"], pa.bool_()), "n_items": pa.array(out["n_items"], pa.int64())})

    told = each.select("id", "item", "n_words", "weight", "n_items", "windows").mapInArrow(judge, "id bigint, item bigint, n_windows bigint, coverage double, reparameterised boolean, n_items bigint")
    best = F.max(F.struct("coverage", (~F.col("reparameterised")).alias("same"), "n_windows", "n_items"))
    told = told.groupBy("id", "item").agg(best.alias("b")).select("id", "item", "b.n_windows", "b.coverage", (~F.col("b.same")).alias("reparameterised"), "b.n_items")
    return told.select(F.col("id").cast(kinds[0]).alias(id_col), F.col("item").cast(kinds[1]).alias(item_col), "n_windows", "coverage", "reparameterised", "n_items")


def best_occurrence(n_words: int, windows: list[dict], weight: float | None = None) -> tuple[int, float, bool]:
    """What consistent() says of the occurrence that covers most of the item; between equal ones, of one with the item's own
    values. Windows of one alignment are an occurrence; as words may have been put in or left out, so are those of
    alignments that lie closer together than half of the item, and all together."""
    aligned: dict[int, list[dict]] = {}
    for w in windows:
        aligned.setdefault(w["at"] - w["item_at"], []).append(w)
    near, last = [], None
    strong = [w for w in windows if not w.get("weak")]
    for shift in sorted({w["at"] - w["item_at"] for w in strong}):
        if last is None or shift - last >= max(1, n_words / 2):
            near.append([])
        near[-1] += [w for w in aligned[shift] if not w.get("weak")]
        last = shift
    tried = [windows] if len(aligned) == 1 else [*aligned.values(), *near, strong]
    return max((consistent(n_words, some, weight) for some in tried), key=lambda x: (x[1], not x[2], x[0]))


def consistent(n_words: int, windows: list[dict], weight: float | None = None) -> tuple[int, float, bool]:
    """Windows of the item whose slots agree with the commonest value for each of the item's values, the share of the
    item's words that they cover, by weight (their sum; the number of words without one), and whether some value differs from
    the item's. Weak windows count only where all of the item's words are covered."""
    votes: dict[str, dict[str, int]] = {}
    for w in windows:
        for theirs, own in zip(w["item_slots"], w["slots"]):
            votes.setdefault(theirs, {}).setdefault(own, 0)
            votes[theirs][own] += 1
    # the item's own value wins ties, then the smallest
    chosen = {theirs: min(own, key=lambda v: (-own[v], v != theirs, v)) for theirs, own in votes.items()}
    good = [w for w in windows if all(chosen[theirs] == own for theirs, own in zip(w["item_slots"], w["slots"]))]
    if any(w.get("weak") for w in good) and len({i for w in good for i in range(w["item_at"], w["item_at"] + w["size"])}) < n_words:
        good = [w for w in good if not w.get("weak")]
    covered: dict[int, float] = {}
    for w in good:
        for i in range(w["item_at"], w["item_at"] + w["size"]):
            covered[i] = max(covered.get(i, 0.0), 1 / w.get("df", 1))
    used = {(w["size"], w["item_at"]) for w in good}
    total = max(1, n_words) if weight is None else weight
    return len(used), min(1.0, sum(covered.values()) / total) if total else 0.0, any(a != b for a, b in chosen.items())


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold an item; rows with a null id stay."""
    name = unused("held_id", docs.columns)
    held = written(find_leaks(docs, benchmark, id_col, **options).select(F.col(id_col).alias(name)).distinct(), "leaks")
    return docs.join(held, docs[id_col] == held[name], "left_anti")
