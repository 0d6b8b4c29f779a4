"""Personal data by weak supervision, in DataFrame functions alone.

One scan finds what looks like an e-mail address, an IP address, a card or a phone number: by the base patterns and by wider
ones (disguised addresses, numbers in national form, card numbers with a wrong check digit). Labelers then vote for or
against each span or stay silent: its form, gazetteers of domains, issuers and calling codes, words before and after it, its
edges, the variety of its digits. Expectation maximisation over the counts of vote patterns, of which there are few whatever
the corpus, estimates for each kind how reliable each labeler is, and from that how likely each span is genuine. These
likelihoods train a naive Bayes classifier on finer features of the spans, which has the last word on spans of the wider
patterns; spans of the base patterns always stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import unused, written

#: Kinds in the order in which spans are listed.
KINDS = ["email", "ip", "card", "phone"]
#: Rounds of expectation maximisation.
ROUNDS = 20
#: Weight of what is believed of labelers beforehand, against all spans of a kind as 1.
PRIOR = 0.5
#: Characters before and after a span that are looked at.
AROUND = 48
#: Characters of a span that are kept.
HEAD = 64
#: Values of a feature of the classifier.
VALUES = 32

# The base patterns, in a form that takes time in proportion to the text: an address begins where no character of its kind
# stands before it or where the last match ended, and nothing that is consumed is given back where that couldn't help.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

_NAME, _LABEL = "[A-Za-z0-9._%+-]{1,64}+", "[A-Za-z0-9-]{1,63}+"
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-]){_NAME}(?: ?[\[({{] ?(?i:at) ?[\])}}] ?{_LABEL}(?: ?(?:\.|[\[({{] ?(?i:dot) ?[\])}}]) ?{_LABEL})++| at {_LABEL}(?: dot {_LABEL})++)",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}[ /-][0-9](?:[ -]?[0-9]){4,9}+)(?![0-9])",
}
#: What a text with a match of the wider patterns holds.
HINT = r"(?i)[\[({] ?at ?[\])}]|\bdot\b|[0-9][ .-][0-9]{4}(?![0-9])|(?<![0-9])0[0-9]{1,4}[ /-][0-9]|(?:[0-9a-f]{1,4}:){7}"

# What the labelers know.
TOP_DOMAINS = "com org net edu gov mil int info biz io co eu uk us ca au de fr es it nl be ch at se no dk fi pl pt ie jp cn in br mx ru za nz kr".split()
PLACES = {
    "card": r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14}|6(?:011|5[0-9]{2})[0-9]{12})$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.",
    "phone": r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[235689][0-9]{2})",
}
CUES = {
    "email": "e-?mail|mail|contact|write|address|reach|send|reply|correo|kontakt|adresse|courriel",
    "ip": "ip|host|server|address|addr|client|from|gateway|dns|login|adresse|servidor|serveur",
    "card": "card|visa|mastercard|amex|credit|debit|payment|pay|pan|tarjeta|karte|carte",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|dial|telefon|teléfono|téléphone|handy|rufen",
}
AGAINST = "version|v|release|isbn|issn|doi|serial|order|invoice|section|chapter|figure|fig|table|page|pages|part|article|sku|model|revision|rev"

AGAINST_IT, SILENT, FOR_IT = range(3)
#: What is believed of each labeler beforehand: shares of votes (against, silent, for) on genuine spans, and on others.
LABELERS = {
    "form": ((0.02, 0.03, 0.95), (0.85, 0.05, 0.10)),
    "listed": ((0.10, 0.20, 0.70), (0.45, 0.25, 0.30)),
    "before": ((0.02, 0.58, 0.40), (0.25, 0.73, 0.02)),
    "after": ((0.02, 0.83, 0.15), (0.10, 0.88, 0.02)),
    "edges": ((0.05, 0.05, 0.90), (0.40, 0.10, 0.50)),
    "variety": ((0.05, 0.15, 0.80), (0.35, 0.25, 0.40)),
}

_SPAN = "struct<pass: string, i: int, gap: bigint, size: bigint, kind: string, base: boolean, head: string, before: string, after: string>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _is(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def _told(kind: str, match: Column) -> tuple[Column, Column]:
    """The kind of a match, null where it is none, and whether it is one of the base spans."""
    held = F.length(_digits(match))
    if kind == "email":
        return F.lit("email"), F.lit(True)
    if kind == "ip":
        return F.when(_is(match, rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip"), F.lit(True)
    if kind == "card":
        some = held.between(13, 19)
        return F.when(some, "card"), F.when(some, F.call_function("luhn_check", _digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.when(held.between(9, 15), "phone"), F.lit(True)
    wide = [F.when(_is(match, f"^(?:{p})$"), k) for k, p in WIDE.items()]
    return F.coalesce(*wide), F.lit(False)


def _hits(text: Column, kind: str, pattern: str, hint: Column) -> Column:
    """All matches with the lengths of the texts between them, from which their places follow."""
    cut = lambda t: F.split(t, pattern, -1)

    def one(gaps: Column, match: Column, i: Column) -> Column:
        of, base = _told(kind, match)
        return F.struct(F.lit(kind).alias("pass"), i.alias("i"), F.length(F.get(gaps, i)).cast("bigint").alias("gap"), F.length(match).cast("bigint").alias("size"), of.alias("kind"), base.alias("base"), F.left(match, F.lit(HEAD)).alias("head"), F.right(F.get(gaps, i), F.lit(AROUND)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AROUND)).alias("after"))

    found = let(cut(text), lambda gaps: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda match, i: one(gaps, match, i)))
    return F.when(hint, found).otherwise(F.expr(f"CAST(array() AS array<{_SPAN}>)"))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a number of its own for each row of docs), id, and the matches in its text, a row each; one without a match for a
    text that has none."""
    wide = "|".join(f"(?:{p})" for p in (PHONE, EMAIL, IP, CARD, *WIDE.values()))  # a wider pattern takes nothing from a base one
    passes = [("email", EMAIL, lambda t: F.contains(t, F.lit("@"))), ("ip", IP, lambda t: _is(t, IP)), ("card", CARD, lambda t: _is(t, CARD)), ("phone", PHONE, lambda t: F.contains(t, F.lit("+"))), ("wide", wide, lambda t: _is(t, HINT))]
    text = F.coalesce(docs[text_col], F.lit(""))
    named = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), text.alias("text"))
    every = F.concat(*(_hits(F.col("text"), kind, pattern, hint(F.col("text"))) for kind, pattern, hint in passes))
    return written(named.select("row", "id", F.explode_outer(every).alias("span")).select("row", "id", "span.*"), "matches")


def spans(matches: DataFrame) -> DataFrame:
    """The matches that are of a kind, with start and end in code points (end exclusive)."""
    run = Window.partitionBy("row", "pass").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = matches.filter(F.col("pass").isNotNull()).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run))
    return placed.filter(F.col("kind").isNotNull()).withColumn("start", F.col("end") - F.col("size"))


def _words(c: Column, listed: str) -> Column:
    return _is(F.lower(c), rf"(?<![\p{{L}}0-9])(?:{listed})(?![\p{{L}}0-9])")


def _by_kind(of: dict[str, Column], other: Column) -> Column:
    first, *rest = of.items()
    return reduce(lambda c, x: c.when(F.col("kind") == x[0], x[1]), rest, F.when(F.col("kind") == first[0], first[1])).otherwise(other)


def _vote(against: Column, for_it: Column) -> Column:
    return F.when(F.coalesce(against, F.lit(False)), AGAINST_IT).when(F.coalesce(for_it, F.lit(False)), FOR_IT).otherwise(SILENT)


def votes() -> list[Column]:
    """The labelers' votes on a span, in the order of LABELERS."""
    head, digits = F.col("head"), _digits(F.col("head"))
    wide = F.col("pass") == "wide"
    domain = F.lower(F.regexp_replace(head, r"(?i)^.*?(?:@|[\[({ ] ?at ?[\])} ])", ""))
    last = F.regexp_extract(domain, r"([a-z0-9-]+)[\])} ]*$", 1)
    national = _is(digits, "^[2-9][0-9]{2}[2-9][0-9]{6}$") | _is(head, r"^0[1-9]")
    good_form = {
        "email": _is(last, "^[a-z]{2,24}$") & ~_is(head, r"^\.|\.\.|\.@"),
        "ip": wide | ~_is(head, r"(?:^|\.)0[0-9]|^0\."),
        "card": F.call_function("luhn_check", digits),
        "phone": F.when(wide, national).otherwise(~_is(head, r"^\+0")),
    }
    listed = {"email": last.isin(TOP_DOMAINS), "ip": _is(head, PLACES["ip"]), "card": _is(digits, PLACES["card"]), "phone": ~wide & _is(digits, PLACES["phone"])}
    unlisted = {"email": F.lit(False), "ip": ~wide & ~_is(head, PLACES["ip"]), "card": ~_is(digits, PLACES["card"]), "phone": ~wide & ~_is(digits, PLACES["phone"])}
    form = _by_kind(good_form, F.lit(False))
    before, after = F.substring_index(F.col("before"), "\n", -1), F.substring_index(F.col("after"), "\n", 1)
    cue = lambda c: _by_kind({k: _words(c, w) for k, w in CUES.items()}, F.lit(False))
    near = F.regexp_extract(before, r"([\p{L}]+)[^\p{L}]{0,3}$", 1)
    distinct = F.size(F.array_distinct(F.split(digits, "")))
    joined = _is(F.right(before, F.lit(1)), r"[\p{L}0-9]") | _is(F.left(after, F.lit(1)), r"[\p{L}0-9]")
    has_digits = F.col("kind") != "email"
    return [
        _vote(~form, form),
        _vote(_by_kind(unlisted, F.lit(False)), _by_kind(listed, F.lit(False))),
        _vote(_words(near, AGAINST), cue(before)),
        _vote(F.lit(False), cue(F.left(after, F.lit(24)))),
        _vote(joined, ~joined),
        _vote(has_digits & (distinct <= 2), ~has_digits | (distinct >= 4)),
    ]


def features() -> Column:
    """What the classifier sees of a span beside its votes: numbers below VALUES, six of them."""
    edge = lambda c: F.when(c == "", 0).when(_is(c, r"\s"), 1).when(_is(c, r"\p{L}"), 2).when(_is(c, "[0-9]"), 3).when(_is(c, r"[:;,.]"), 4).otherwise(5)
    near = F.lower(F.regexp_extract("before", r"([\p{L}]+)[^\p{L}]{0,3}$", 1))
    parts = F.length(F.regexp_replace("head", "[0-9A-Za-z]", ""))
    some = [F.when(F.col("pass") == "wide", 1).otherwise(0), F.least(F.floor(F.col("size") / 3), F.lit(VALUES - 1)), F.least(parts, F.lit(VALUES - 1)), edge(F.right("before", F.lit(1))), edge(F.left("after", F.lit(1))), F.pmod(F.xxhash64(near), F.lit(VALUES))]
    return F.array(*(c.cast("int") for c in some))


def reliabilities(patterns: DataFrame) -> DataFrame:
    """kind, model: how likely a span is genuine, and each labeler's shares of votes on genuine spans and on others, from the
    counts of vote patterns (kind, votes, n). A kind has 3 ** len(LABELERS) patterns at most."""
    believed = lambda y: F.array(*(F.array(*map(F.lit, x[y])) for x in LABELERS.values()))
    start = F.struct(F.lit(0.5).alias("share"), believed(0).alias("yes"), believed(1).alias("no"))

    def shares(weighed: Column, total: Column, y: int) -> Column:
        """Of each labeler and vote the share, by the patterns' weights w, with what is believed beforehand."""
        mine = F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x["w"])
        prior = PRIOR * total
        of = lambda j, v: F.aggregate(weighed, F.lit(0.0), lambda a, x: a + F.when(F.get(x["votes"], j) == v, x["w"]).otherwise(0.0))
        return F.array(*(F.array(*((of(F.lit(j), v) + prior * F.lit(x[y][v])) / (mine + prior) for v in range(3))) for j, x in enumerate(LABELERS.values())))

    def step(model: Column, counts: Column, total: Column) -> Column:
        p = F.transform(counts, lambda c: F.struct(c["votes"].alias("votes"), c["n"].alias("n"), genuine(model, c["votes"]).alias("p")))
        yes = lambda ps: F.transform(ps, lambda c: F.struct(c["votes"].alias("votes"), (c["n"] * c["p"]).alias("w")))
        no = lambda ps: F.transform(ps, lambda c: F.struct(c["votes"].alias("votes"), (c["n"] * (1 - c["p"])).alias("w")))
        share = lambda ps: (F.aggregate(ps, F.lit(0.0), lambda a, c: a + c["n"] * c["p"]) + PRIOR * total / 2) / (total * (1 + PRIOR))
        return let(p, lambda ps: F.struct(share(ps).alias("share"), let(yes(ps), lambda w: shares(w, total, 0)).alias("yes"), let(no(ps), lambda w: shares(w, total, 1)).alias("no")))

    by = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("counts"), F.sum("n").cast("double").alias("total"))
    return by.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda model, _: step(model, F.col("counts"), F.col("total"))).alias("model"))


def genuine(model: Column, votes: Column) -> Column:
    """How likely a span with these votes is genuine."""
    product = lambda told: reduce(lambda a, j: a * F.get(F.get(told, F.lit(j)), F.get(votes, F.lit(j))), range(len(LABELERS)), F.lit(1.0))
    yes, no = model["share"] * product(model["yes"]), (1 - model["share"]) * product(model["no"])
    return F.least(F.greatest(yes / (yes + no), F.lit(1e-12)), F.lit(1 - 1e-12))


def classifier(marked: DataFrame) -> DataFrame:
    """kind, odds (a map of log odds by feature * VALUES + value): naive Bayes from spans with features and p. What few
    genuine or other spans say of a feature's values weighs little against the shares of the values among all."""
    each = marked.select("kind", "p", F.posexplode("features").alias("j", "v")).groupBy("kind", (F.col("j") * VALUES + F.col("v")).alias("key")).agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    total = marked.groupBy("kind").agg(F.sum("p").alias("all_yes"), F.sum(1 - F.col("p")).alias("all_no"))
    every = F.col("all_yes") + F.col("all_no")
    held = (F.col("yes") + F.col("no")) * PRIOR  # the value's share of PRIOR times all spans
    odds = F.log((F.col("yes") + held) / (F.col("all_yes") + PRIOR * every)) - F.log((F.col("no") + held) / (F.col("all_no") + PRIOR * every))
    return each.join(F.broadcast(total), "kind").groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("key", odds.alias("odds")))).alias("odds"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: id, spans (array of struct<kind, start, end, base, score>, by kind as in KINDS, then start), in
    code points with the end exclusive. base: found by a base pattern; such spans always stay, others where the classifier's
    score is `threshold` or more.

    A null or empty text has no spans. Repeated rows and ids, null ids among them, each keep their row and each count in
    training. Base spans of different kinds may overlap each other; a wider pattern's span doesn't overlap what the base
    patterns consume. An empty table gives an empty result. Other columns are ignored. Texts are read whole, whatever their
    length.
    """
    name = unused("row", [id_col])
    matches = scanned(docs, id_col, text_col)
    found = spans(matches).withColumn("votes", F.array(*votes())).withColumn("features", features())
    found = written(found.select("row", "id", "kind", "start", "end", "base", "votes", "features"), "spans")
    # 3 ** labelers patterns a kind at most, one model a kind, and VALUES log odds for each of its features
    patterns = found.groupBy("kind", "votes").agg(F.count("*").alias("n"))
    models = written(reliabilities(patterns), "reliabilities")
    marked = found.join(F.broadcast(models), "kind").withColumn("p", genuine(F.col("model"), F.col("votes"))).drop("model", "votes")
    marked = written(marked, "marked-spans")
    judge = F.broadcast(written(classifier(marked), "span-classifier"))
    learned = F.aggregate(F.transform("features", lambda v, j: F.element_at("odds", (j * VALUES + v).cast("int"))), F.lit(0.0), lambda a, x: a + x)
    scored = marked.join(judge, "kind").withColumn("score", 1 / (1 + F.exp(F.log((1 - F.col("p")) / F.col("p")) - learned))).filter(F.col("base") | (F.col("score") >= threshold))
    order = F.array_position(F.lit(KINDS), F.col("kind"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("order"), "start", "end", "kind", "base", "score"))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score")))
    # a row's matches are a row each, or one without a match
    every = matches.select("row", "id").groupBy("row").agg(F.first("id").alias("id"))
    held = scored.groupBy("row").agg(listed.alias("spans"))
    empty = F.expr("CAST(array() AS array<struct<kind: string, start: bigint, end: bigint, base: boolean, score: double>>)")
    told = every.withColumnRenamed("row", name).join(held.withColumnRenamed("row", name), name, "left")
    return told.select(F.col("id").alias(id_col), F.coalesce("spans", empty).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
