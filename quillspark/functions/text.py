"""Text functions as Column expressions.

Java's classes are ASCII unless a pattern starts with (?U); the patterns below say so where Unicode white space and words
count. Functions take and return Columns; null gives null unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lazy import arrow_function

# Fixed values.
UNKNOWN_METADATA = ["unknown", "unknown author", "unknown title", "untitled", "n/a", "na", "none", "null", "no data", "no author", "not specified", "unspecified"]
PHRASE_PREFIXES = ["An Order for ", "A Collect for ", "Collect for ", "A Prayer of ", "A Prayer for ", "A Litany of "]
MATCHER_STOPWORDS = ["a", "an", "the", "of", "for", "to", "and"]
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "referrer", "mc_cid", "mc_eid"]
RATE_LIMIT_MARKERS = ["session limit", "rate limit", "usage limit"]
TRANSIENT_HINTS = ["HTTP Error 5", "HTTP Error 429", "Temporary failure", "timed out", "Connection reset", "Connection refused", "Read timed out", "Network is unreachable"]
MEDIA_HINTS = ["connection reset", "connection refused", "temporary failure", "resource temporarily unavailable", "out of memory", "cannot allocate memory", "network is unreachable", "timed out", "timeout"]
PLATFORMS = ["claude", "chatgpt", "other"]
AUDIO_SUFFIXES = ["m4b", "mp3", "m4a", "aac", "ogg", "flac", "wav", "opus"]
CODEC_SUFFIX = r"(?i)[-_](AAX|LC|MP3|M4B|AAC|FLAC|WAV|OGG|OPUS)(_\d+)*(_stereo|_mono)?\s*$"
TRAILING_BRACKET = r"\s*[\[(][^\])]*[\])]\s*$"
NARRATOR_BRACKET = r"\s*\[([^\]]+)\]\s*$"
FILE_DESCRIPTOR = r"(?i)(\s*[\[(](ocr|scan|scanned|converted|retail|epub|pdf|mobi|azw3)[\])][\s\-_]*)+$"
NOISE_MARKER = r"(?i)\b(\d{3,4}p|BluRay|BDRip|BRRip|WEB-DL|WEBRip|HDTV|DVDRip|x264|x265|HEVC|H\.264|H\.265|AVC|XVID|DDP|DTS|AAC|AC3|MP3|FLAC|HDR|SDR|UHD|Atmos|S\d{2}E\d{2}|S\d{2}\b|19\d{2}|20\d{2}|COMPLETE|REPACK|PROPER|EXTENDED|THEATRICAL|MULTI)"


def strip(c: Column, chars: str = r"(?U)\s") -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, rf"(?U)^\s+|\s+$" if chars == r"(?U)\s" else f"^[{chars}]+|[{chars}]+$", "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(c: Column) -> Column:
    """The text's words between white space (Unicode); none for a blank text."""
    return F.when(strip(c) == "", F.array().cast("array<string>")).otherwise(F.split(strip(c), r"(?U)\s+"))


def paragraphs(c: Column) -> Column:
    """Parts between two or more line feeds, stripped, blank ones left out."""
    return F.filter(F.transform(F.split(c, "\n{2,}"), lambda x: strip(x)), lambda p: p != "")


def optional(c: Column) -> Column:
    """Stripped; blank is null."""
    return F.nullif(strip(c), F.lit(""))


def url_slug(c: Column, longest: int = 60, fallback: str = "capture") -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one dash, cut to `longest` characters; empty gives the fallback."""
    cut = F.substring(strip(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "-"), 1, longest)
    return F.coalesce(F.nullif(F.regexp_replace(cut, "-+$", ""), F.lit("")), F.lit(fallback))


@arrow_function("string")
def without_accents(c: pd.Series) -> pd.Series:
    """Decomposed (NFKD), without what isn't ASCII then."""
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def ascii_slug(c: Column, tail: Column | None = None) -> Column:
    """Accents off, lower case, other characters as underscores; tail after an underscore. Only texts that aren't ASCII
    have to leave the JVM, which knows no decomposition."""
    odd = F.when(F.regexp_like(c, F.lit(r"[^\x00-\x7F]")), c)
    slug = strip(F.regexp_replace(F.lower(F.coalesce(without_accents(odd), c)), "[^a-z0-9]+", "_"), "_")
    return slug if tail is None else F.concat(slug, F.lit("_"), tail)


def yaml_scalar(c: Column) -> Column:
    """In double quotes, backslashes and quotes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def labelled_header(fields: list[tuple[str, Column]]) -> Column:
    """`Label: value` lines of the fields that aren't blank, and a blank line after them; empty if all are."""
    lines = F.array_compact(F.array(*[F.when(strip(v) != "", F.concat(F.lit(f"{label}: "), strip(v))) for label, v in fields]))
    return F.when(F.size(lines) == 0, F.lit("")).otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n\n")))


def without_header(c: Column, labels: list[str]) -> Column:
    """Without leading `Label: value` lines of known labels and the blank line after them."""
    return F.regexp_replace(c, rf"^((?:{'|'.join(labels)}): [^\n]*\n)+\n", "")


def match_phrases(title: Column) -> Column:
    """The title, what follows a known prefix, and what stands in parentheses, if long enough; each once, whatever its case."""
    whole = F.when(F.length(strip(title)) >= 4, strip(title))
    derived = [F.when(title.startswith(p) & (F.length(title) > len(p)), strip(F.substring(title, len(p) + 1, 1 << 20))) for p in PHRASE_PREFIXES]
    inner = F.nullif(strip(F.regexp_extract(title, r"\(([^)]+)\)", 1)), F.lit(""))
    long = [F.when(F.length(d) >= 6, d) for d in [*derived, inner]]
    # of equal ones in different case, the first stays
    first = lambda every: let(F.transform(every, lambda p: F.lower(p)), lambda keys: F.filter(every, lambda p, i: F.array_position(keys, F.lower(p)) == i + 1))
    return let(F.array_compact(F.array(whole, *long)), first)


def phrase_in(phrase: Column, text: Column) -> Column:
    """Whether the phrase stands in the text between word boundaries, whatever its case."""
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(?U)\b\Q"), F.lower(phrase), F.lit(r"\E\b")))


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def canonical_url(url: Column) -> Column:
    """Of http and https addresses with a host: without fragment, an empty path as /, the query kept. Others give null."""
    m = r"^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?"
    path, query = F.regexp_extract(url, m, 3), F.regexp_extract(url, m, 4)
    return F.when(F.regexp_like(url, F.lit(m)), F.concat(F.regexp_extract(url, m, 1), F.lit("://"), F.regexp_extract(url, m, 2), F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "?", F.lit("")).otherwise(query)))


def canonical_url_untracked(url: Column) -> Column:
    """As canonical_url, without tracking parameters."""

    def bare(whole):
        base = F.regexp_extract(whole, r"^([^?]*)", 1)
        params = F.filter(F.split(F.regexp_extract(whole, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(TRACKING_PARAMS))
        return let(params, lambda ps: F.when(F.size(ps) > 0, F.concat(base, F.lit("?"), F.array_join(ps, "&"))).otherwise(base))

    return let(canonical_url(url), bare)


def hostname(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def video_id(url: Column) -> Column:
    """The 11 characters that name a video, from the known shapes of addresses or the v parameter."""
    shapes = [r"youtu\.be/([a-zA-Z0-9_-]{11})", r"youtube\.com/watch\?(?:.*&)?v=([a-zA-Z0-9_-]{11})", r"youtube\.com/shorts/([a-zA-Z0-9_-]{11})", r"youtube\.com/embed/([a-zA-Z0-9_-]{11})"]
    return F.coalesce(*[F.nullif(F.regexp_extract(url, s, 1), F.lit("")) for s in shapes])


def canonical_video_url(key: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), key)


def podcast_id(url: Column) -> Column:
    return F.when(F.contains(hostname(url), F.lit("apple.com")), F.nullif(F.regexp_extract(url, r"/id(\d+)", 1), F.lit("")))


def post_parts(url: Column) -> Column:
    """struct<actor, rkey> of a post's address."""
    m = r"/profile/([^/]+)/post/([^/?#]+)"
    return F.when(F.regexp_like(url, F.lit(m)), F.struct(F.regexp_extract(url, m, 1).alias("actor"), F.regexp_extract(url, m, 2).alias("rkey")))


def cache_path(url: Column) -> Column:
    """Where a page of this address is kept: host, sanitised segments, a digest of the query, .html."""
    host = F.coalesce(hostname(url), F.lit(""))
    path, query = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(F.when(F.regexp_like(s, F.lit(r"^\.+$")), F.lit("__dot__")).otherwise(s), r"[^a-zA-Z0-9\-_.]", "_"))
    tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("__q"), F.substring(F.sha2(query, 256), 1, 8)))

    def named(parts):
        last = F.try_element_at(parts, F.lit(-1))
        name = F.when(F.size(parts) == 0, F.concat(F.lit("index"), tail, F.lit(".html"))).when(F.regexp_like(F.lower(last), F.lit(r"\.html?$")), F.concat(last, tail)).otherwise(F.concat(last, tail, F.lit(".html")))
        return F.array_join(F.concat(F.array(host), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(name)), "/")

    return let(parts, named)


def episode_title(c: Column) -> Column:
    """Lower case without punctuation, white space collapsed: for comparing."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(c)), r"(?U)[^\w\s]", ""), r"(?U)\s+", " ")


def match_key(c: Column) -> Column:
    """Lower case, punctuation as blanks, white space collapsed; null is empty."""
    return F.coalesce(strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")), F.lit(""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def text_similarity(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b))))


def cue_text(c: Column) -> Column:
    """Caption text of VTT or SRT: without headers, cue numbers, times and tags, consecutive repeats once, joined by blanks."""
    lines = F.transform(F.split(c, r"\r\n|\n|\r"), lambda x: strip(x))
    said = F.filter(lines, lambda x: (x != "") & ~F.regexp_like(x, F.lit(r"^(WEBVTT|Kind:|Language:|NOTE)|^\d+$|^\d{2}:\d{2}:\d{2}[.,]\d{3}\s*-->")))
    clean = F.filter(F.transform(said, lambda x: strip(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")
    return let(clean, lambda ls: F.array_join(F.filter(ls, lambda x, i: (i == 0) | (x != F.get(ls, i - 1))), " "))


def transcript_text(c: Column, kind: Column) -> Column:
    """By declared type or shape: caption text, or the text with white space collapsed."""
    cues = kind.contains("vtt") | kind.contains("srt") | kind.contains("subrip") | c.startswith("WEBVTT") | F.regexp_like(c, F.lit(r"\d{2}:\d{2}:\d{2}[.,]\d{3}\s*-->"))
    return F.when(cues, cue_text(c)).otherwise(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def trigram_share(c: Column) -> Column:
    """Share of the commonest run of three words; 0 with fewer than 30 words. Hashes of the runs are sorted, so that equal
    ones meet; k equal ones stand k - 1 apart. (Of different runs, two hashes of 64 bits are hardly ever equal.)"""

    def share(w):
        runs = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))))

        def commonest(s):
            n = F.size(s)
            # how many runs have an equal one k places on tells whether some occurs more than k times
            repeats = F.filter(s, lambda x, i: x == F.get(s, i + 1))
            step = lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(2)).alias("run"), F.greatest(a["best"], F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(2))).alias("best"))
            start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(1).alias("run"), F.lit(1).alias("best"))
            return F.aggregate(repeats, start, step, lambda a: a["best"]) / n

        return F.when(F.size(w) >= 30, let(runs, commonest)).otherwise(F.lit(0.0))

    return let(words(F.lower(c)), share)


def caption_ok(c: Column, seconds: Column, share: Column | None = None) -> Column:
    """Whether captions are usable: long enough, punctuated, not repetitive (share: their trigram_share, if it is known),
    and spoken at a plausible rate."""
    n = F.size(words(c))
    rate = F.try_divide(n, seconds / 60)
    repeated = trigram_share(c) if share is None else share
    return (F.length(strip(c)) >= 50) & (F.regexp_count(c, F.lit("[.?!,;:]")) / n >= 0.01) & (repeated <= 0.1) & F.coalesce((seconds <= 30) | rate.between(30, 400), F.lit(True))


def audiobook_title(c: Column) -> Column:
    """Without codec suffix, trailing bracket and underscores."""
    bare = F.regexp_replace(F.regexp_replace(F.translate(c, "꞉", ":"), CODEC_SUFFIX, ""), TRAILING_BRACKET, "")
    return strip(F.regexp_replace(F.translate(bare, "_", " "), " {2,}", " "))


def author_title(folder: Column) -> Column:
    """struct<author, title> of a folder named `Author - Title`; without an author the whole is the title."""
    raw = F.regexp_replace(F.translate(folder, "꞉", ":"), NARRATOR_BRACKET, "")
    raw = F.regexp_replace(strip(F.regexp_replace(raw, TRAILING_BRACKET, "")), CODEC_SUFFIX, "")
    raw = strip(F.regexp_replace(F.translate(raw, "_", " "), " {2,}", " "))

    def parted(raw):
        m = r"^(.+?)\s+-\s+(.+)$"
        left, right = strip(F.regexp_extract(raw, m, 1)), strip(F.regexp_extract(raw, m, 2))
        named = (left != "") & F.regexp_like(left, F.lit(r"[\s,]|^[A-Z]"))
        return F.struct(F.when(named, left).alias("author"), F.when(named, right).otherwise(raw).alias("title"))

    return let(raw, parted)


def file_label(c: Column) -> Column:
    """A file name's segment: dashes alike, underscores as blanks, trailing descriptors off; blank is null."""
    plain = F.translate(c, "‐‑‒–—_", "----- ")
    edges = strip(F.regexp_replace(plain, r"(?U)\s+", " "), r" \-_")
    return F.nullif(strip(F.regexp_replace(edges, FILE_DESCRIPTOR, ""), r" \-_"), F.lit(""))


def metadata_value(c: Column) -> Column:
    """White space collapsed; null if blank or a placeholder."""
    clean = F.nullif(strip(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))
    return let(clean, lambda v: F.when(~F.lower(strip(v, r"\[\](){}")).isin(UNKNOWN_METADATA), v))


def looks_like_author(c: Column) -> Column:
    """Whether a label is probably a person's name."""

    def judged(bare):
        odd = F.regexp_like(F.lower(bare), F.lit(r"isbn|annas archive|z-library|library genesis")) | F.regexp_like(bare, F.lit(r"[/\\@\d]")) | (F.length(bare) > 100) | F.regexp_like(F.lower(bare), F.lit("^[0-9a-f]{8,}$"))
        n = F.regexp_count(bare, F.lit(r"[A-Za-z][A-Za-z'.]*"))
        return F.coalesce(metadata_value(bare).isNotNull() & ~odd & n.between(2, 10) & F.regexp_like(bare, F.lit(r"\p{Lu}")), F.lit(False))

    return let(file_label(c), judged)


def name_case(c: Column) -> Column:
    """Of a name all in capitals: title case, where a letter after anything but a letter is a capital; small words lower."""

    def cased(name):
        parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\p{L}+|\P{L}+)"))
        titled = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "")
        for w in ("And", "Of", "The", "A", "An", "De", "Da", "Van", "Von"):
            titled = F.regexp_replace(titled, rf"\b{w}\b", w.lower())
        return F.when(F.regexp_like(name, F.lit(r"\p{L}")) & ~F.regexp_like(name, F.lit(r"\p{Ll}")), titled).otherwise(name)

    return let(c, cased)


def book_label(c: Column) -> Column:
    """struct<title, author> of `Title -- Author` or `Author - Title`, if the author looks like a name."""

    def parted(label):
        twice, m = F.split(label, r"\s+--\s+"), r"^(.+?)\s+-\s+(.+)$"
        found = F.struct(file_label(F.get(twice, F.lit(0))).alias("t2"), name_case(file_label(F.get(twice, F.lit(1)))).alias("a2"), name_case(file_label(F.regexp_extract(label, m, 1))).alias("a1"), file_label(F.regexp_extract(label, m, 2)).alias("t1"))
        return let(found, lambda s: F.when(looks_like_author(s["a2"]), F.struct(s["t2"].alias("title"), s["a2"].alias("author"))).when(looks_like_author(s["a1"]), F.struct(s["t1"].alias("title"), s["a1"].alias("author"))))

    return let(file_label(c), parted)


def book_metadata(file_stem: Column, title: Column, author: Column) -> Column:
    """struct<title, author>: what was extracted, else what the file's name says, else what the title says."""
    told = F.struct(book_label(file_stem).alias("named"), metadata_value(title).alias("title"), metadata_value(author).alias("author"))

    def chosen(s):
        both = F.struct(F.coalesce(s["title"], s["named"]["title"]).alias("title"), F.coalesce(s["author"], s["named"]["author"]).alias("author"))
        return let(both, lambda b: let(F.when(b["author"].isNull(), book_label(b["title"])), lambda of: F.struct(F.coalesce(of["title"], b["title"]).alias("title"), F.coalesce(b["author"], of["author"]).alias("author"))))

    return let(told, chosen)


def video_title(c: Column) -> Column:
    """A release name's title: up to the first marker of quality, season or year."""
    at = F.regexp_instr(c, F.lit(NOISE_MARKER))
    return F.nullif(F.when(at > 0, strip(F.substring(c, F.lit(1), at - 1), r" .\-_")).otherwise(strip(c)), F.lit(""))


def video_name(c: Column) -> Column:
    """struct<title, year, season, episode> of a release name."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"(?i)\.(mkv|mp4|avi|m4v|mov|wmv|mpg|mpeg|ts)$", ""), r"^\s*\[[^\]]+\]\s*", "")

    def parted(bare):
        number = lambda m, g: F.nullif(F.regexp_extract(bare, m, g), F.lit("")).cast("int")
        title = strip(F.regexp_replace(F.translate(video_title(bare), "._", "  "), r"\s+", " "))
        return F.struct(F.regexp_replace(title, r"\s*[\[(]+$", "").alias("title"), number(r"\b((?:19|20)\d{2})\b", 1).alias("year"), number(r"(?i)\bS(\d{2})", 1).alias("season"), number(r"(?i)\bS\d{2}E(\d{2})\b", 1).alias("episode"))

    return let(bare, parted)


def derived_title(c: Column, fallback: Column, longest: int = 80) -> Column:
    """The first line that isn't blank, without heading marks, cut to `longest` characters."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(strip(x), "^#+", ""))), lambda x: x != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, longest), fallback)


def highlight_sections(c: Column) -> Column:
    """A session's text before `### N.` headings, and from each of them on."""
    return F.filter(F.transform(F.split(c, r"(?m)(?=^### \d+\.)"), lambda x: strip(x)), lambda x: x != "")


def session_title(c: Column) -> Column:
    """struct<date, suffix, couples> of `Month D, YYYY -- suffix`."""
    m = r"^\s*([A-Z][a-z]+ \d{1,2}, \d{4})\s*(?:(?:--|—|–|-)\s*(.*))?$"
    suffix = F.nullif(strip(F.regexp_extract(c, m, 2)), F.lit(""))
    return F.struct(F.try_to_date(F.nullif(F.regexp_extract(c, m, 1), F.lit("")), "MMMM d, yyyy").alias("date"), suffix.alias("suffix"), F.coalesce(F.contains(F.lower(suffix), F.lit("couples")), F.lit(False)).alias("couples"))


def matcher_tokens(c: Column) -> Column:
    """Tokens for matching titles: stopwords out, numbers without leading zeros, plurals with their singular."""
    tokens = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), " +"), lambda t: (t != "") & ~t.isin(MATCHER_STOPWORDS))

    def forms(t):
        number = F.regexp_like(t, F.lit(r"^\d+$"))
        plural = ~number & (F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss")
        plain = F.when(number, F.regexp_replace(t, r"^0+(?=\d)", "")).otherwise(t)
        return F.when(plural, F.array(t, F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(F.array(plain))

    return F.array_distinct(F.flatten(F.transform(tokens, forms)))


def slug_tokens(c: Column) -> Column:
    return matcher_tokens(F.regexp_replace(F.regexp_replace(c, "_(anglican|orthodox|catholic)$", ""), r"_rite-(i|ii|iii)$", ""))


def kind_matches(source_type: Column, genre: Column, title: Column, expected: Column) -> Column:
    """Whether a hit is of the kind expected: bios are prose, dashes and underscores alike, a prayer titled collect counts."""
    want, have = F.translate(expected, "-", "_"), F.translate(F.coalesce(genre, F.lit("")), "-", "_")
    collect = (want == "collect") & (have == "prayer") & F.regexp_like(F.lower(title), F.lit(r"^\s*(collect|a collect )"))
    return F.when(expected == "bio", source_type == "prose").otherwise((source_type == "liturgical_unit") & ((have == want) | F.coalesce(collect, F.lit(False))))


def title_overlaps(title: Column, slug: Column) -> Column:
    want = slug_tokens(slug)
    return (F.size(want) > 0) & (F.size(F.array_intersect(want, matcher_tokens(title))) >= F.least(F.lit(2), F.size(want)))


def without_code_fence(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"^```[a-zA-Z]*\n|\n```$", "")


def approximate_tokens(c: Column) -> Column:
    return F.floor(F.greatest(F.size(words(c)) * 1.3, F.length(c) / 4) + 0.5).cast("int")


def worth_summary(c: Column, least: int = 2000) -> Column:
    return F.size(words(c)) >= least


def missing_quotes(quotes: Column, source: Column) -> Column:
    return F.filter(quotes, lambda q: (q != "") & ~F.contains(source, q))


def rate_limited(c: Column) -> Column:
    return F.regexp_like(F.lower(c), F.lit("|".join(RATE_LIMIT_MARKERS)))


def transient_error(c: Column) -> Column:
    return F.regexp_like(c, F.lit("|".join(TRANSIENT_HINTS)))


def looks_like_asin(c: Column) -> Column:
    return F.regexp_like(c, F.lit("^B[0-9A-Z]{9}$"))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def snippet(c: Column, longest: int = 300) -> Column:
    return F.substring(c, 1, longest)


def directives(c: Column) -> Column:
    """Lines `[directive, date] text`, in order."""
    return F.filter(F.split(c, "\n"), lambda x: F.regexp_like(x, F.lit(r"^\s*(?:- )?\[directive, \d{4}-\d{2}-\d{2}\] \S")))


def directives_lost(before: Column, after: Column) -> Column:
    return let(directives(after), lambda kept: F.filter(directives(before), lambda x: ~F.array_contains(kept, x)))


def transient_media_error(c: Column) -> Column:
    return F.regexp_like(F.lower(c), F.lit("|".join(MEDIA_HINTS)))


def platform(c: Column) -> Column:
    """struct<platform, error>: one of the known platforms; null is the first."""
    named = F.lower(strip(c))
    known = named.isin(PLATFORMS)
    return F.struct(F.when(c.isNull(), PLATFORMS[0]).when(known, named).alias("platform"), F.when(c.isNotNull() & ~known, "unknown platform").alias("error"))


def first_date(*texts: Column) -> Column:
    """The first yyyy-mm-dd in the first text that has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")) for c in texts])


def transcript_address(transcripts: Column, links: Column) -> Column:
    """struct<url, type>: the first landed transcript (array<struct<url, href, type>>) with an address, else the first link
    (array<struct<rel, href, type>>) that is one."""
    one = lambda url, kind: F.struct(url.alias("url"), F.coalesce(kind, F.lit("text/plain")).alias("type"))
    own = F.filter(F.transform(transcripts, lambda t: one(F.coalesce(F.nullif(t["url"], F.lit("")), F.nullif(t["href"], F.lit(""))), t["type"])), lambda t: t["url"].isNotNull())
    linked = F.transform(F.filter(links, lambda x: x["rel"] == "transcript"), lambda x: one(x["href"], x["type"]))
    return F.coalesce(F.get(own, F.lit(0)), F.get(linked, F.lit(0)))
