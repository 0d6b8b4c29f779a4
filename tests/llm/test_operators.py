"""The operators against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

import numpy as np
import public_tokenizers
import pytest

from quillspark.llm import ann_forest, decontaminate, language_id, license_scan, line_dedup, near_dedup, sentencepiece_codec, substring_dedup, token_counts, toxicity

from . import brute

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def some_docs(seed=1, n=60):
    """Random texts with shared passages, copies, near copies, repeated lines, nulls and a long text."""
    rnd = random.Random(seed)
    make = lambda k: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ".", "\n"]) for _ in range(k))
    passage, line = make(40), "This Line Is Long Enough To Count As Repeated Text."
    texts = [None, "", " \t ", "one", "two words", make(4000)]
    for i in range(n):
        base = make(rnd.randrange(1, 120))
        texts.append(base)
        if i % 4 == 0:
            texts.append(base + " " + passage + " " + make(5))
        if i % 6 == 0:
            texts.append(base)
        if i % 5 == 0:
            cut = base.split(" ")
            cut[rnd.randrange(len(cut))] = "changed"
            texts.append(" ".join(cut))
        if i % 3 == 0:
            texts.append(make(3) + "\n" + line.upper() + "  \n" + make(3) + "\n\t" + line)
    rnd.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, docs):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], "doc_id long, text string, id string, n int, block int")


EMPTY = "doc_id long, text string"


def test_substring_dedup(spark):
    docs = some_docs()
    found = substring_dedup.dedup_substrings(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in found) == sorted(brute.substring_dedup(docs))
    assert all(s.length >= 13 and s.source < r.doc_id for r in found for s in r.spans)
    for r in found:  # each factor's words stand in its source
        for s in r.spans:
            mine, theirs = (brute.WORD.findall(dict(docs)[d]) for d in (r.doc_id, s.source))
            assert mine[s.start : s.start + s.length] == theirs[s.source_start : s.source_start + s.length]
    assert max(s.length for r in found for s in r.spans) >= 40
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], EMPTY)).count() == 0


def test_substring_dedup_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(substring_dedup, "BUCKET_SEEDS", 200)
    docs = some_docs(7)
    found = substring_dedup.dedup_substrings(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in found) == sorted(brute.substring_dedup(docs))


def test_equal_fingerprints_of_other_words():
    seeds, checks = np.array([5, 7, 5, 5, 7], np.uint64), np.array([1, 1, 2, 1, 1], np.uint16)
    order, starts = substring_dedup.equal_runs(seeds, checks)
    assert [sorted(x.tolist()) for x in np.split(order, starts[1:])] == [[0, 3], [2], [1, 4]]
    assert [x.tolist() for x in substring_dedup.equal_runs(seeds[:0], checks[:0])] == [[], []]


def test_substring_dedup_repeated_and_null_ids(spark):
    long = " ".join(WORDS)
    docs = [(5, long), (5, long), (7, long), (None, long), (None, None)]
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_dedup.dedup_substrings(spark.createDataFrame(docs, EMPTY)).collect())
    assert found == [(False, 5, 0), (False, 5, 0), (False, 7, 20), (True, 0, 0), (True, 0, 0)]


def test_line_dedup(spark):
    docs = some_docs(2)
    found = line_dedup.dedup_lines(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, brute.sha(r.kept or "")) for r in found) == sorted(brute.line_dedup(docs))
    assert [r.kept for r in found if dict(docs)[r.doc_id] is None] == [None]
    assert line_dedup.dedup_lines(spark.createDataFrame([], EMPTY)).count() == 0


def test_line_dedup_repeated_and_null_ids(spark):
    line = "a line that is clearly longer than forty characters in all"
    docs = [(i, line) for i in range(5)] + [(4, line), (None, line)]
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, EMPTY)).collect()))
    assert found == [*((False, i, 1) for i in range(4)), (False, 4, 0), (False, 4, 0), (True, 0, 0)]


@pytest.mark.parametrize("bits, keys, hot", [(512, 1 << 21, 10_000), (1 << 29, 16, 3), (1 << 29, 1 << 21, 1)])
def test_line_dedup_of_any_size(spark, monkeypatch, bits, keys, hot):
    """A full filter of ids costs rows, not results; ranges of few keys, and keys that are hot or not, change nothing."""
    monkeypatch.setattr(line_dedup, "FILTER_BITS", bits)
    monkeypatch.setattr(line_dedup, "RANGE_KEYS", keys)
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
    docs = some_docs(3)
    found = line_dedup.dedup_lines(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, brute.sha(r.kept or "")) for r in found) == sorted(brute.line_dedup(docs))


def test_line_dedup_shuffles_only_documents_that_lose_lines(spark, monkeypatch):
    """However small the ranges, the ids that are marked are those that lose lines, and few others pass the filter."""
    monkeypatch.setattr(line_dedup, "RANGE_KEYS", 64)
    own = lambda i: f"a line of its own that nothing else has, number {i} of very many"
    docs = [(i, "\n".join([own(2 * i), own(2 * i + 1), *(["a line that every tenth document has, and so is repeated"] if i % 10 == 0 else [])])) for i in range(2000)]
    lost = line_dedup.lost_lines(spark.createDataFrame(docs, EMPTY), "doc_id", "text", 40, 5)
    assert {r.id for r in lost.collect()} == set(range(0, 1990, 10))
    bits = line_dedup.id_filter(lost.selectExpr("xxhash64(id) AS h"), 199)
    every = np.array([r.h for r in spark.range(2000).selectExpr("xxhash64(id) AS h").collect()], np.int64).view(np.uint64)
    assert 199 <= line_dedup.holds(bits, every).sum() < 230
    again = line_dedup.suspects(spark.createDataFrame([(i // 2 if i < 40 else i,) for i in range(3000)], "h long"), 3000)
    found = {r.h: r.n for r in again.collect()}
    assert all(found[h] == 2 for h in range(20)) and len(found) < 300


@pytest.mark.parametrize("shingle, threshold", [(3, 0.85), (5, 0.8)])
def test_near_dedup(spark, shingle, threshold):
    docs = some_docs(4)
    found = near_dedup.near_duplicates(frame(spark, docs), shingle=shingle, threshold=threshold).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == sorted(brute.near_dedup(docs, shingle, round(100 * threshold)))


def test_near_dedup_chains_and_large_groups(spark):
    """A chain of texts, each near the next only, and a group of hundreds of variants."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    docs, cut = [], list(base)
    for i in range(30):
        cut = cut[3:] + [f"c{i}a", f"c{i}b", f"c{i}c"]
        docs.append((i, " ".join(cut)))
    for i in range(300):
        own = list(base)
        own[rnd.randrange(100)] = f"v{i}"
        docs.append((1000 + i, " ".join(own)))
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, EMPTY), shingle=3, threshold=0.85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == sorted(brute.near_dedup(docs))


def around_the_threshold(n, seed):
    """Variants of one text, most of them just below the threshold to each other (0.85 of 3-word shingles), some above."""
    rnd = random.Random(seed)
    base, out = [f"w{i}" for i in range(120)], []
    for i in range(n):
        own = list(base)
        for at in rnd.sample(range(0, 120, 4), rnd.choice([1, 3, 4, 4, 4])):
            own[at] = f"x{rnd.randrange(40)}"
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("block, sketch", [(16, 64), (2048, None)])
def test_near_dedup_variants_around_the_threshold(spark, monkeypatch, block, sketch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = around_the_threshold(250, 9)
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, EMPTY), shingle=3, threshold=0.85, sketch=sketch).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == sorted(brute.near_dedup(docs))


def test_near_dedup_links_of_just_the_threshold(spark):
    """Pairs with 85 of 100 shingles of their union in common, many times: none may be lost."""
    docs = []
    for i in range(300):
        # 85 shared shingles, 7 and 8 of either side's own
        shared = [f"s{i}_{k}" for k in range(87)]
        docs += [(2 * i, " ".join(shared + [f"a{i}_{k}" for k in range(7)])), (2 * i + 1, " ".join(shared + [f"b{i}_{k}" for k in range(8)]))]
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, EMPTY), shingle=3, threshold=0.85).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in found) and len(found) == 600


def test_block_links_join_components_only_once():
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    text = [f"w{i}" for i in range(40)]
    members = [{"class_id": i, "component": i, "asks": i > 0, "z": pack(" ".join(text + [f"v{i}"]).encode())} for i in range(5)]
    members += [{**m, "asks": False} for m in members[1:]]
    members.append({"class_id": 9, "component": 9, "asks": False, "z": pack(b"something else altogether")})
    links = near_dedup.block_links(members, 3, 0.85)
    assert len(links) == 4 and {i for link in links for i in link} == set(range(5))
    assert near_dedup.block_links(members[:1], 3, 0.85) == []


def test_near_dedup_edges(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0
    docs = [(1, None), (2, ""), (3, "same text"), (4, "Same  TEXT"), (None, "same text"), (4, "Same  TEXT")]
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, EMPTY)).collect())
    assert found == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False)]


def test_token_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(6)
    odd = ["".join(rnd.choice("aB é\t\n\r\x0b\x85  ▁'s0٩①ﬁ中😀‍İΣςÅ가|<>") for _ in range(rnd.randrange(60))) for _ in range(200)]
    docs = list(enumerate([None, "", "it's <|startoftext|> THE<|endoftext|>", "word " * 3000, *odd, *odd[:20]]))
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time, the cache has all
        found = token_counts.count_tokens(frame(spark, docs), path, cache).collect()
        assert sorted(tuple(r) for r in found) == sorted((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 2048) for d, t in docs)
    kept = spark.read.parquet(cache)
    assert kept.count() == kept.select("text_sha").distinct().count()
    assert token_counts.count_tokens(spark.createDataFrame([], EMPTY), path).count() == 0


def test_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(8)
    odd = ["".join(rnd.choice("aB é\t\n  ▁▁'s0①ﬁ中😀\x00<s>") for _ in range(rnd.randrange(50))) for _ in range(300)]
    docs = list(enumerate([None, "", " ", "  a  ", "x " * 5000, *odd]))
    found = sentencepiece_codec.encode_decode(frame(spark, docs), path, with_ids=True, with_text=True).collect()
    for r in found:
        ids = library.encode(dict(docs)[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids))
        assert r.ids_sha256 == __import__("hashlib").sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == brute.sha(r.decoded)
    assert len(found) == len(docs)
    assert sentencepiece_codec.encode_decode(spark.createDataFrame([], EMPTY), path).count() == 0


def test_license_scan(spark):
    texts = [None, "", "under the MIT\nLicense, the Apache-License; GNU General Public License", "cc by cc by-nc 4.0", "xmit license", "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nrest", "SPDX-License-Identifier: (MIT OR", "é mit license é", "all rights reserved " * 500]
    docs = list(enumerate(texts))
    found = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, docs)).collect()}
    for d, t in docs:
        r = found[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(t)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert found[5].labels == "apache,gpl,mit" and found[5].expression_demands == 1
    assert found[6].expression_demands is None
    assert license_scan.scan_licenses(spark.createDataFrame([], EMPTY)).count() == 0


def test_license_expressions():
    assert license_scan.postfix("MIT or Apache-2.0 and BSD") == ["MIT", "Apache-2.0", "BSD", "and", "or"]
    assert license_scan.postfix("(MIT or ISC) and GPL-3.0+ with X") == ["MIT", "ISC", "or", "GPL-3.0+", "X", "with", "and"]
    for bad in ("", "and", "MIT and", "(MIT", "MIT)", "or MIT"):
        assert license_scan.postfix(bad) is None
    assert license_scan.evaluate("GPL-3.0 OR MIT") == ({"gpl", "mit"}, 1)


def test_toxicity(spark):
    rnd = random.Random(9)
    bad = ["abusive", "horrid", "nastyish"]
    docs, labels = [], []
    for i in range(400):
        ws = [rnd.choice(WORDS) for _ in range(30)]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                ws[rnd.randrange(30)] = rnd.choice(bad)
        docs.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    d, lab = frame(spark, docs + [(1000, None), (1001, ""), (1002, "alpha abusve horridd beta"), (None, "x")]), spark.createDataFrame(labels + [(5, None)], "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    assert set(bad) <= set(model.lexicon)
    found = toxicity.score_toxicity(d, model).collect()
    assert len(found) == 404 and all(0 <= r.score <= 1 for r in found)
    said = {r.doc_id: r.predicted for r in found}
    assert all(said[i] == t for i, t in labels) and said[1000] == 0 and said[1002] == 1
    assert toxicity.score_toxicity(spark.createDataFrame([], EMPTY), model).count() == 0


def test_toxicity_without_labels(spark):
    model = toxicity.train(frame(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score_toxicity(frame(spark, [(1, "a"), (2, None)]), model).collect()] == [0.5, 0.5]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_levenshtein_automaton():
    rnd = random.Random(10)
    lexicon = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 8))) for _ in range(20)})
    machine = toxicity.Automaton(lexicon)
    tried = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 10))) for _ in range(2000)]
    points = np.frombuffer(" ".join(tried).encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0, *[len(t) + 1 for t in tried[:-1]]])
    state = machine.read(points, starts, np.array([len(t) for t in tried]))
    for t, s in zip(tried, state):
        want = min((levenshtein(t, w) for w in lexicon if levenshtein(t, w) <= toxicity.edits(w)), default=None)
        assert (machine.edits[s] if machine.word[s] >= 0 else None) == want


def test_misspelled_with_digits_and_symbols():
    model = toxicity.Model(["idiot", "moron", "pathetic"])
    hit = ["m0ron", "a id*ot!", "(p@thetic)", "mo-ron", "mo_ron", "moro7n"]
    clean = ["m0r0n", "mo ron", "m\nron", "id**ot", "m", "", None, "7", "a-b"]
    x = toxicity.features(model, [t.encode() if t is not None else None for t in [*hit, *clean, "moron-idiot", "moron"]])
    assert np.expm1(x[:, 2]).round().tolist() == [1] * len(hit) + [0] * (len(clean) + 2)
    assert np.expm1(x[:, 1]).round().tolist() == [0] * (len(hit) + len(clean)) + [2, 1]


def test_lexicon_of_rare_short_and_many_words(spark):
    rnd = random.Random(14)
    terms = ["zut", *("q" + chr(97 + i // 26) + chr(97 + i % 26) + "xj" for i in range(109))]
    text = lambda *more: " ".join([*rnd.choices(WORDS, k=12), *more])
    rows = [(text(terms[i % len(terms)], "end"), 1) for i in range(440)] + [(text("end"), 0) for _ in range(4000)]
    assert toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int")) == sorted(terms)


def test_language_id(spark):
    rnd = random.Random(11)
    alphabets = {"aa": "abcde ", "bb": "vwxyz ", "cc": "éèàùô "}
    docs = [(i, "".join(rnd.choice(alphabets[lang]) for _ in range(80)), lang) for i, lang in enumerate(list(alphabets) * 60)]
    d = spark.createDataFrame([*docs, (900, None, "aa"), (901, "123 !?", "aa"), (902, "", None), (None, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.train(d)
    found = language_id.identify(d, model, keep=["lang", "text"]).collect()
    assert len(found) == len(docs) + 4 and all(0 <= r.score <= 1 for r in found)
    said = {r.doc_id: r.lang_pred for r in found}
    assert all(said[i] == lang for i, t, lang in docs if t.strip())
    assert [said[i] for i in (900, 901, 902)] == ["und"] * 3
    assert language_id.identify(d.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(d, language_id.train(d.limit(0))).collect()} == {"und"}


def test_decontamination(spark):
    items = [(1, "If Anna buys 3 red apples and 5 green pears for Tom then how many pieces of fruit does Anna carry home"), (2, "what is the boiling point of pure water"), (3, None), (4, ""), (5, "Short item here")]
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod "
    texts = [
        None,
        "",
        filler + items[0][1] + " " + filler,
        filler + "if Mary buys 7 red apples and 9 green pears for Joe then how many pieces of fruit does Mary carry home. " + filler,
        filler * 50,
        "they said what is the boiling point of pure water, again",
        "and a short Item-free, short item here!",
        filler + "how many pieces of fruit does it take " + filler,
    ]
    docs = list(enumerate(texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(frame(spark, docs), bench).collect()}
    assert set(found) == {(2, 1), (3, 1), (5, 2), (6, 5)}
    assert found[3, 1].reparameterised and not found[2, 1].reparameterised
    left = decontaminate.remove_leaks(frame(spark, [*docs, (None, items[0][1])]), bench)
    assert {r.doc_id for r in left.collect()} == {None, 0, 1, 4, 7}
    assert decontaminate.find_leaks(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(frame(spark, docs).limit(0), bench).count() == 0


def leaks(spark, items, docs):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(frame(spark, list(enumerate(docs))), bench).collect()}


def test_decontamination_of_items_dense_in_slots(spark):
    items = ["3 1 4 1 5 9 2 6 5 3 5 8 9 7", "what is 12 plus 37 minus 8 times 4 plus 190 minus 3", "17 km 4 hours", "present were Anna Smith Tom Jones Mary Brown Joe White Sue Black", "12 kg 7 m"]
    docs = ["see " + item + ", and so on" for item in items] + ["3 1 4 1 5 0 2 6 5 3 0 8 9 7", "18 km 4 hours"]
    found = leaks(spark, items, docs)
    assert set(found) == {(i, i) for i in range(len(items))}
    assert all(r.coverage == 1 and not r.reparameterised for r in found.values())


def test_decontamination_of_other_case_and_lines(spark):
    items = ["What is the boiling point of pure water", "If Anna and Tom meet Sue in Rome with 3 pears then Bob and Ann in Bonn eat 5 of them before Joe does", "Can Anna reach the town in 3 hours"]
    docs = ["they asked What is the boiling point of pure water", "- What is the boiling point of pure water", "so WHAT IS THE BOILING POINT OF PURE WATER"]
    docs += ["so " + items[1].lower(), "so " + items[1].upper(), items[1].replace(" ", "\n"), items[1].upper().replace("3", "4")]
    docs += ["- Can Mary reach the town in 7 hours", "Will Mary reach the town in 7 hours"]
    found = leaks(spark, items, docs)
    assert set(found) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1), (7, 2)}
    assert all(found[d, i].coverage == 1 for d, i in found)
    assert {d for (d, _), r in found.items() if r.reparameterised} == {6, 7}


def test_decontamination_of_several_occurrences(spark):
    form = "so {0} has {1} blue marbles and buys {2} more, how many marbles does {0} have then"
    items = [form.format("Anna", 3, 4)]
    one, two, three = form.format("Zoe", 8, 5), form.format("Bea", 9, 1), form.format("Bea", 7, 6)
    broken = lambda text: text.replace("and buys", "and then buys")
    docs = [one + ". " + two, two + ". " + three + ". " + form.format("Bea", 2, 9) + ". " + items[0], broken(one), broken(one) + ". " + broken(two)]
    found = leaks(spark, items, docs)
    assert set(found) == {(i, 0) for i in range(4)}
    assert found[0, 0].coverage == 1 and found[1, 0].coverage == 1
    assert [found[i, 0].reparameterised for i in range(4)] == [True, False, True, True]


def test_decontamination_of_what_items_share(spark):
    """An instruction that all items begin with says nothing of any of them, whatever its share of their words; an item that
    stands in a document as a whole is found, and so is a passage that two items share."""
    rnd = random.Random(20)
    make = lambda k: " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) + "x" for _ in range(k))
    lead = "please work out the answer to the following question about"
    items = [f"{lead} {make(10)}" for _ in range(120)]
    passage = make(40)
    items += [f"{passage} {make(8)}", f"{passage} {make(8)}"]
    docs = [f"{make(5)} {lead} {make(30)}" for _ in range(120)] + [f"so {items[7]} and", f"so {passage} and", f"{make(4)} {items[121]}"]
    found = leaks(spark, items, docs)
    assert {(d, i) for d, i in found if d < 120} == set()
    assert {(d, i) for d, i in found if d >= 120} == {(120, 7), (121, 120), (121, 121), (122, 121), (122, 120)}
    assert found[120, 7].coverage == 1 and found[122, 121].coverage == 1 and found[122, 120].coverage < 1


def test_decontamination_of_short_items_with_other_values(spark):
    items = ["A train goes 60 km in 2 hours how fast", "Ann paid 9 dollars for tea"]
    docs = ["well, a train goes 75 km in 3 hours how fast is it", "so Bob paid 7 dollars for tea", "It rained. Bob paid 7 dollars for tea.", "a train goes 75 km in 3 hours and stops", "Bob paid 7 dollars for coffee", "nobody paid 7 dollars for tea", "Ann paid 9 dollars for tea"]
    found = leaks(spark, items, docs)
    assert set(found) == {(0, 0), (1, 1), (2, 1), (6, 1)}
    assert {d for (d, _), r in found.items() if r.reparameterised} == {0, 1, 2}


def test_decontamination_against_whole_templates(spark):
    """Items with other values at random places, and ones with a value that doesn't stay the same."""
    rnd = random.Random(21)
    names, items, docs, want = ["Anna", "Tom", "Mary", "Joe", "Zoe", "Bea"], [], [], set()
    for i in range(40):
        words = [rnd.choice(WORDS) + str(rnd.randrange(100)) + "q" for _ in range(24)]
        who, n = rnd.choice(names), str(rnd.randrange(2, 50))
        for at in (5, 13, 21):
            words[at] = who
        for at in (9, 17):
            words[at] = n
        items.append(" ".join(words))
        other, m = rnd.choice([x for x in names if x != who]), str(rnd.randrange(50, 99))
        copy = [{who: other, n: m}.get(w, w) for w in words]
        kind = i % 4
        if kind == 1:  # other names in each place, so that most windows contradict each other
            copy[13], copy[21] = "Eve", "Ida"
            copy[17] = str(int(m) + 1)
        elif kind == 2:  # half of it only
            copy = copy[:10]
        elif kind == 3:
            copy = words
        docs.append(" ".join(["some", "words", "before", *copy, "and", "after"]))
        if kind in (0, 3):
            want.add((i, i))
    found = leaks(spark, items, docs)
    assert set(found) == want and all(found[i, i].reparameterised == (i % 4 == 0) for i, _ in want)


def test_decontamination_far_apart_in_a_long_text(spark):
    """Of a very long text with thousands of copies, the best one counts; halves that lie far apart are no copy."""
    rnd = random.Random(22)
    item = " ".join(rnd.choice(WORDS) + str(i) + "y" for i in range(20))
    half = item.split()
    docs = [(item.upper() + " between ") * 3000, " ".join(half[:9]) + " far" * 500 + " " + " ".join(half[11:]), "x" * 300_000 + " " + item]
    assert {(d, r.coverage) for (d, _), r in leaks(spark, [item], docs).items()} == {(0, 1.0), (2, 1.0)}


def test_best_occurrence():
    w = lambda shift, at, own: {"size": 8, "at": at + shift, "item_at": at, "slots": own, "item_slots": ["anna", "3"]}
    copies = [w(0, 0, ["zoe", "3"]), w(0, 1, ["zoe", "3"]), w(40, 0, ["anna", "9"]), w(40, 1, ["anna", "9"])]
    assert decontaminate.consistent(9, copies) == (0, 0.0, False)
    assert decontaminate.best_occurrence(9, copies) == (2, 1.0, True)
    assert decontaminate.best_occurrence(9, [*copies, w(80, 0, ["anna", "3"]), w(80, 1, ["anna", "3"])]) == (2, 1.0, False)
    # a word put in between the halves
    assert decontaminate.best_occurrence(30, [w(0, 0, ["zoe", "3"]), w(1, 12, ["zoe", "3"]), w(100, 0, ["bea", "4"]), w(101, 12, ["bea", "4"])]) == (2, 16 / 30, True)


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 7)
    rnd = random.Random(12)
    items = [(i, " ".join(rnd.choice(WORDS) + str(rnd.randrange(3)) + "x" for _ in range(20))) for i in range(10)]
    docs = [(i, "start " + items[i][1] + " end") for i in range(10)]
    found = decontaminate.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(10)}


def test_slot_consistency():
    w = lambda at, theirs, own: {"size": 8, "at": at, "item_at": at, "slots": own, "item_slots": theirs}
    assert decontaminate.consistent(10, [w(0, ["Anna"], ["Mary"]), w(1, ["Anna"], ["Mary"]), w(2, ["Anna"], ["Joe"])]) == (2, 0.9, True)
    assert decontaminate.consistent(8, [w(0, ["Anna"], ["Anna"])]) == (1, 1.0, False)


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, score int")


def test_ann_forest_recall(spark):
    rnd = np.random.default_rng(13)
    x = rnd.standard_normal((600, 16)) * rnd.uniform(0.5, 2, (600, 1))
    x[100:140] = x[100]
    rows = [(i, [float(np.float32(c)) for c in v], 0, 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0, 0), (1001, [0.0] * 16, 0, 0), (1002, [float("nan")] * 16, 0, 0), (1003, [None] * 16, 0, 0), (1020, [1.0], 0, 0), (None, rows[0][1], 0, 0)]
    found = ann_forest.search(vectors_frame(spark, rows), "vec_id % 20 = 0", k=20).collect()
    held = np.array([r[1] for r in rows[:600]])
    hits, by = 0, {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 600, 20))
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21))
        assert [(r.score, -r.vec_id) for r in rs] == sorted(((r.score, -r.vec_id) for r in rs), reverse=True)
        s = held @ held[q]
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 and r.vec_id != q for r in rs)
        s[q] = -np.inf
        hits += len({r.vec_id for r in rs} & set(np.lexsort((np.arange(600), -s))[:20].tolist()))
    assert hits / (20 * len(by)) >= 0.9


def test_ann_forest_small_and_ties(spark):
    v = [1.0, 0.0]
    found = ann_forest.search(vectors_frame(spark, [(i, v, 0, 0) for i in range(30)]), "vec_id = 0", k=5).collect()
    assert sorted((r["rank"], r.vec_id) for r in found) == [(i, i) for i in range(1, 6)]
    few = ann_forest.search(vectors_frame(spark, [(0, v, 0, 0), (1, [0.5, 0.5], 0, 0), (1, [0.5, 0.5], 0, 0)]), "vec_id = 0", k=5).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in few] == [(1, 1, 0.5)]
    assert ann_forest.search(vectors_frame(spark, []), "vec_id = 0").count() == 0
    assert ann_forest.search(vectors_frame(spark, [(0, None, 0, 0)]), "vec_id = 0").count() == 0


def test_ann_forest_blocks(spark, monkeypatch):
    """Small blocks, so that queries meet several, and prefixes deeper than the directory."""
    monkeypatch.setattr(ann_forest, "BLOCK_ROWS", 40)
    rnd = np.random.default_rng(14)
    centers = rnd.standard_normal((6, 12)) * 4
    x = centers[rnd.integers(0, 6, 500)] + rnd.standard_normal((500, 12))
    rows = [(i, [float(np.float32(c)) for c in v], 0, 0) for i, v in enumerate(x)]
    for share in (0.7, 0.1):
        found = ann_forest.search(vectors_frame(spark, rows), "vec_id % 25 = 0", k=5, share=share).collect()
        held, hits = np.array([r[1] for r in rows]), 0
        for q in range(0, 500, 25):
            s = held @ held[q]
            s[q] = -np.inf
            hits += len({r.vec_id for r in found if r.query_id == q} & set(np.argsort(-s)[:5].tolist()))
        assert len(found) == 100 and hits / 100 >= (0.9 if share == 0.7 else 0.6)


@pytest.mark.parametrize("clusters", [250, 0])
def test_ann_forest_finds_how_many_candidates_it_needs(spark, clusters):
    """5,000 vectors in clusters, which need few candidates, and evenly spread ones, which need most rows."""
    rnd = np.random.default_rng(15)
    x = rnd.standard_normal((5000, 24))
    if clusters:
        x = 0.35 * x + (rnd.standard_normal((clusters, 24)) * 2)[rnd.integers(0, clusters, 5000)]
    x = x.astype(np.float32).astype(np.float64)
    rows = vectors_frame(spark, [(i, v.tolist(), 0, 0) for i, v in enumerate(x)])
    found = ann_forest.search(rows, "vec_id % 50 = 0", k=10).collect()
    hits = 0
    for q in range(0, 5000, 50):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in found if r.query_id == q} & set(np.argsort(-s)[:10].tolist()))
    assert len(found) == 1000 and hits / 1000 >= 0.9


def test_spread_vectors_need_more_candidates_than_clusters(spark):
    rnd, wanted = np.random.default_rng(20), []
    for clusters in (250, 0):
        x = rnd.standard_normal((5000, 24))
        if clusters:
            x = 0.35 * x + (rnd.standard_normal((clusters, 24)) * 2)[rnd.integers(0, clusters, 5000)]
        entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entry long, v array<double>")
        planes = ann_forest.Planes(rnd.standard_normal((16, 64, 25)), np.zeros((16, 64)), float((x * x).sum(axis=1).max()))
        queries = entries.filter("entry % 50 = 0").withColumnRenamed("entry", "query")
        wanted.append(ann_forest.enough(entries, queries, spark.sparkContext.broadcast(planes), 24, 5000, 10, 0.95, 64))
    assert 2 * wanted[0] < wanted[1] < 16 * 5000


def test_ann_forest_many_queries_in_a_block(spark, monkeypatch):
    monkeypatch.setattr(ann_forest, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann_forest, "BLOCK_QUERIES", 16)
    rnd = np.random.default_rng(16)
    x = rnd.standard_normal((300, 8)).astype(np.float32).astype(np.float64)
    x[:100] = x[0] + 0.01 * x[:100]
    found = ann_forest.search(vectors_frame(spark, [(i, v.tolist(), 0, 0) for i, v in enumerate(x.astype(np.float32).astype(float))]), "vec_id < 120", k=5, share=16.0).collect()
    held = x.astype(np.float32).astype(np.float64)
    for q in range(120):
        s = held @ held[q]
        s[q] = -np.inf
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(300), -s))[:5].tolist()


def test_token_counts_of_a_tokenizer_that_keeps_white_space(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = list(enumerate([None, "", "two  blanks", "Upper CASE\n\n lines ", "it's <|endoftext|> é ①", "word " * 3000, "two  blanks"]))
    found = token_counts.count_tokens(frame(spark, docs), path).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in found) == [(d, len(library.encode(t or "", add_special_tokens=False))) for d, t in docs]
    assert token_counts.splits_at_white_space(public_tokenizers.path("word_bpe_49k.json")) and not token_counts.splits_at_white_space(path)


def test_license_labels_against_a_plain_scan(spark):
    rnd = random.Random(17)
    phrases = {**license_scan.MORE, **license_scan.BASE}
    docs = []
    for i in range(120):
        parts = [rnd.choice([*phrases, *WORDS, "license", "cc", "by"]) for _ in range(rnd.randrange(12))]
        docs.append((i, rnd.choice([" ", "-", "\n", ", "]).join(p.upper() if rnd.random() < 0.3 else p for p in parts)))
    docs += [(500, docs[3][1]), (500, docs[3][1]), (None, docs[4][1])]
    rows = license_scan.scan_licenses(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = dict(docs)[r.doc_id]
        ws = brute.LICENSE_WORD.findall(brute.ascii_lower(text))
        labels = {label for p, label in phrases.items() if any(ws[i : i + len(p.split())] == p.split() for i in range(len(ws)))}
        assert r.labels == ",".join(sorted(labels)) and r.score == (1 - 0.3 ** min(len(labels), 8) if labels else 0)


def test_license_tags(spark):
    texts = ["SPDX-License-Identifier:\nMIT OR ISC", "// SPDX-License-Identifier: MIT or any later version", "/* SPDX-License-Identifier: (GPL-2.0-only AND Zlib)\n * rest */", "SPDX License Identifier", "é spdx-license-identifier: Apache-2.0\nx\nSPDX-License-Identifier: BSD-3-Clause this file is"]
    found = {r.doc_id: (r.labels, r.expression_demands) for r in license_scan.scan_licenses(frame(spark, list(enumerate(texts)))).collect()}
    assert found == {0: ("isc,mit", 1), 1: ("mit", 1), 2: ("gpl,zlib", 5), 3: ("", None), 4: ("apache,bsd", 1)}


def test_decontamination_of_many_items_of_one_template(spark):
    form = "so {0} has {1} blue marbles and buys {2} more, how many marbles does {0} have then"
    names = ["Anna", "Bea", "Zoe", "Tom", "Joe", "Sue"]
    items = [form.format(names[i % 6], i + 2, 3 * i + 5) for i in range(60)]
    docs = [*items, form.format("Kim", 500, 501)]
    found = leaks(spark, items, docs)
    assert {(i, i) for i in range(60)} <= set(found) and (60, 0) in found
    assert all(not found[i, i].reparameterised and found[i, i].coverage == 1 for i in range(60)) and found[60, 0].reparameterised
    assert len(found) < 61 * 8 and found[60, 0].n_items == 60


def test_decontamination_of_repeated_rows(spark):
    item = "what is the boiling point of pure water at sea level then"
    docs = [(1, "so " + item), (1, "so " + item), (2, item), (None, item)]
    found = decontaminate.find_leaks(frame(spark, docs), spark.createDataFrame([(7, item), (8, item), (7, item), (None, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in found) == [(d, i, 1.0) for d in (1, 2) for i in (7, 8)]


def test_quotation_and_abuse():
    model = toxicity.Model(["moron"])
    score = lambda text: toxicity.features(model, [text.encode()])[0][1:5] > 0  # noqa: E731  exact, misspelled, quoted, to someone
    assert score("you are a moron").tolist() == [True, False, False, True]
    assert score("a morron there").tolist() == [False, True, False, False]
    assert score('the word "moron" in a dictionary').tolist() == [False, False, True, False]
    assert score("he said moron to them").tolist() == [False, False, True, False]
    assert score("nothing of the kind").tolist() == [False] * 4
    assert toxicity.features(model, [("calm sounds " * 20000 + "you moron").encode()])[0][1] > 0


def plain_toxic_hits(lexicon, text):
    """Words within the allowed edits of a lexicon word, by comparing each with each."""
    return sum(any(levenshtein(w, x) <= toxicity.edits(x) for x in lexicon) for w in toxicity._WORD.findall(text.lower()))


def test_toxicity_against_a_plain_lexicon():
    rnd = random.Random(18)
    lexicon = ["horrid", "nasty", "idiot", "vile"]
    model = toxicity.Model(lexicon)
    texts = []
    for _ in range(150):
        ws = [rnd.choice([*WORDS, *lexicon]) for _ in range(rnd.randrange(1, 15))]
        ws = [w if rnd.random() < 0.6 else w[: (k := rnd.randrange(len(w)))] + rnd.choice(["", "x", w[k]]) + w[k + 1 :] for w in ws]
        texts.append(" ".join(w for w in ws if w))
    counts = np.expm1(toxicity.features(model, [t.encode() for t in texts])[:, 1:4]).sum(axis=1)
    assert counts.round().astype(int).tolist() == [plain_toxic_hits(lexicon, t) for t in texts]


def test_language_id_against_plain_bayes(spark):
    """Log-probabilities summed n-gram by n-gram; ties go to the first language."""
    rnd = random.Random(19)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "xyzwé"}
    docs = [(i, " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randrange(1, 8))) for _ in range(rnd.randrange(1, 30))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.train(d)
    for text in [t for _, t, _ in docs[:40]] + ["abc " * 30000]:
        points, _ = language_id.joined([text.encode()])
        plain = model.priors.copy()
        for order in language_id.ORDERS:
            for b in language_id.buckets(points, order).tolist():
                plain = plain + model.weights[:, b]
        odds = np.exp(plain - plain.max())
        assert np.allclose(language_id.scores(model, [text.encode()])[0], odds / odds.sum(), atol=1e-4)
    tied = language_id.Model(["aa", "bb"], np.zeros((2, 3 << language_id.BITS), np.float32), np.log([0.5, 0.5]))
    assert [tuple(r) for r in language_id.identify(spark.createDataFrame([(1, "x"), (1, "x")], EMPTY), tied).collect()] == [(1, "aa", 0.5)] * 2
