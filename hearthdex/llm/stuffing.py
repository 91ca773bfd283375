"""Pages of repeated keywords, bare links or product tags instead of sentences.

Every document's text is cut into lines and runs between sentence ends. Each piece is one
of: code (fenced, or by its signs), log or table line, sentence, link (addresses,
anchors, breadcrumbs, hash tags) or loose words. A page is spam when most of its
characters are bare links, or loose words that repeat and lack the function words that
running text of its language has. What share of function words running text has, and how much
it repeats itself, is measured over all documents of a language. Languages without a list of function words
are told by their script, and their common words are learned from all documents' sentences; there loose words
must repeat or be parted by separators as well.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from hearthdex.session import materialized, spread

#: Function words by language. Fixed values.
FUNCTION_WORDS = {
    "en": "the a an of to in is are it its and or not that this with for from by on at as be been was were if when then "
    "than no but we they you there their has have had can may must will would should into before after until only once "
    "each every which what how why who does do did so our your his her nothing",
    "de": "der die das ein eine einen einem einer und oder nicht ist sind war wird werden mit ohne von vom zu zum zur für auf "
    "im in den dem des als wenn dann aber wir sie es er man nur noch nach vor bei sich auch so wie was kein keine hat haben kann je etwa darf seit bis doch dass weil ob diese dieser dieses jede jeder jeden über unter am mehr sehr hier",
    "fr": "le la les un une des de du et ou ne pas est sont était avec sans pour par sur dans en que qui quand si mais nous vous "
    "ils elle il se sa son ses ce cette au aux plus puis avant après on y a",
    "es": "el la los las una un unos y o no es son fue con sin por para en que quien cuando si pero nos se su sus lo al del de más "
    "antes después como hay a",
}
#: Characters and endings that running Chinese and Japanese text uses for grammar. Fixed values.
FUNCTION_SIGNS = {"zh": "的是在会了把要有没就不从可以这也每个约当时你如果但之前后到已被让给和与及或都还只才又于此该其他们我它什么为着过所因而则且", "ja": "はをがのにもでとまからすたんりいな"}

#: First and last letters of scripts without a list above; Latin letters that its four languages lack. Fixed values.
SCRIPTS = {"greek": "Ͱ-Ͽ", "cyrillic": "Ѐ-ԯ", "armenian": "԰-֏", "hebrew": "֐-׿", "arabic": "؀-ۿ", "devanagari": "ऀ-ॿ", "bengali": "ঀ-৿", "tamil": "஀-௿", "thai": "฀-๿", "georgian": "Ⴀ-ჿ", "hangul": "가-힣"}
OTHER_LATIN = "ąćęłńśźżčďěňřšťůžğışőűåøæãõāēģīķļņūėįųđħŋþðăâîșț"

_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_SCRIPT = {k: re.compile(f"[{v}]+") for k, v in SCRIPTS.items()}
_OTHER = re.compile("[\u0370-\u1fff\uac00-\ud7af" + OTHER_LATIN + "]")
_OTHER_LATIN = re.compile(f"[{OTHER_LATIN}]")
_SEPARATOR = re.compile(r"[,;|·•/、，；»›]")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+")
_ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a>|\[([^\]\n]*)\]\([^)\n]*\)", re.I | re.S)
_TAG = re.compile(r"<[^>\n]*>")
_HASH = re.compile(r"#\w+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_MARKS = "\u0300-\u036f\u064b-\u065f\u0900-\u0963\u0966-\u0dff\u0e31-\u0e4e"  # signs of vowels stand inside words
_ANY_MARK, _MARKED_WORD = re.compile(f"[{_MARKS}]"), re.compile(rf"(?:[^\W_]+[{_MARKS}]*)+(?:['’][^\W_]+)?")
_DIGITS = re.compile(r"\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_END = re.compile(r"(?<=[.!?…])\s+(?=\S)|(?<=[。！？])")
_STOP = re.compile(r"[.!?…。！？:;][\"'”’)\]]*\s*$")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]|\[?\d\d:\d\d:\d\d|(?:DEBUG|INFO|WARN|ERROR|TRACE)\b)")
_CODE = re.compile(r"[{};]\s*$|^\s*(?:def |fn |pub |let |const |var |return\b|if \(|for \(|import |from \w+ import|class |#include|@\w+)|^\s*[\w.\[\]]+ [-+*/]?= |=>|::|\w\(.*\)[;:]?\s*$|^\s*//")
_BREAD = re.compile(r"\s[>»›|/·•→]\s")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_KEY = re.compile(r"^\s*[\w.-]+\s*[:=]\s*\S+\s*$")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")

#: Words that loose text or sentences must have to be judged; most common words that count as top.
LEAST_WORDS, TOP_WORDS = 12, 12
#: Words from which repetition alone is judged, part of the letters by which a script is a text's, part of the letters
#: that are no listed language's, and part of the function words below which a Latin text with those is of another language.
FEW_WORDS, SCRIPT_SHARE, OTHER_SHARE, OTHER_GRAMMAR = 6, 0.5, 0.01, 0.1
#: Common words of a document that count for learning, documents that a language needs for it, part of them that
#: must have a word, and words learned at most.
COMMON, LEARN_FROM, LEARN_SHARE, LEARNED = 30, 20, 0.25, 60
#: Separators to loose words from which a text of an unknown language is a list of tags, and the different lines
#: that so many lines have at most where they only say a phrase again.
SEPARATORS, FEW_LINES, LEAST_LINES = 0.3, 2, 8
#: Part of a language's usual share of function words below which text is no running text,
#: and the usual share where no document of the language has running text.
GRAMMAR, USUAL_GRAMMAR = 0.5, 0.3
#: Loose words repeat when their top words have this share and at most this part is distinct.
TOP_SHARE, DISTINCT = 0.45, 0.45
#: Part of a language's usual top share that must be passed as well, and the usual distinct part by it.
USUAL_PART = 0.85
#: Share of the words that the most common pair or triple of words covers in stuffed text,
#: how often it must come, and the part of the usual grammar below which sentences may be so.
PHRASE, PHRASE_TIMES, PHRASE_GRAMMAR = 0.3, 4, 0.8
#: Words of a key phrase, at most.
LONGEST = 5
#: Part of the characters from which a page counts.
MOST = 0.5

KINDS = ("code", "log", "sentence", "link", "loose")


def language_of_words(words: list[str], text: str) -> tuple[str, int, int]:
    """``language, words of grammar, words`` by which language's function words are the most; ``x-`` and a script without a list."""
    cjk = len(_CJK.findall(text))
    if cjk * 2 > len(words) + cjk:
        kana = sum("\u3040" <= c <= "\u30ff" for c in text)
        name = "ja" if kana * 8 > cjk else "zh"
        signs = FUNCTION_SIGNS[name]
        return name, sum(c in signs for c in text), cjk
    count = Counter(words)
    hits = {k: sum(n for w, n in count.items() if w in s) for k, s in _SETS.items()}
    name = max(hits, key=hits.get)
    if _OTHER.search(text):
        letters = max(1, sum(map(len, _LETTERS.findall(text))))
        size = {k: sum(map(len, r.findall(text))) for k, r in _SCRIPT.items()}
        script = max(size, key=size.get)
        if size[script] > SCRIPT_SHARE * letters:
            return f"x-{script}", 0, len(words)
        if len(_OTHER_LATIN.findall(text)) >= OTHER_SHARE * letters and hits[name] < OTHER_GRAMMAR * len(words):
            return "x-latin", 0, len(words)
    return name, hits[name], len(words)


def pieces(text: str) -> Iterator[tuple[str, str]]:
    """``kind, piece`` of each line, sentence or link of a text."""
    fenced = False
    for line in re.split(r"\r\n|[\r\n\u2028\u0085]", text):
        if _FENCE.match(line):
            fenced = not fenced
            continue
        bare = line.strip()
        if not bare:
            continue
        if fenced:
            yield "code", bare
            continue
        if _LOG.match(bare):
            yield "log", bare
            continue
        urls = _URL.findall(bare)
        if urls or "<a" in bare or "](" in bare:
            # what stands around and inside the links decides
            rest = _TAG.sub(" ", _URL.sub(" ", _ANCHOR.sub(" ", bare)))
            words = _WORD.findall(rest)
            if (_STOP.search(rest) and len(words) >= 4) or (len(_CJK.findall(rest)) >= 8 and re.search(r"[。！？]", rest)):
                yield "sentence", bare
            else:
                yield "link", bare
            continue
        tags = _HASH.findall(bare)
        if len(tags) >= 2 and sum(map(len, tags)) * 2 > len(bare):
            yield "link", bare
            continue
        if len(_BREAD.findall(bare)) >= 2 and not _STOP.search(bare) and bare.count("|") < 2 + 3 * (not bare.startswith("|")) and not bare.startswith("|"):
            words = _WORD.findall(bare)
            yield ("loose" if len(words) > 40 else "link"), bare
            continue
        bare = _TAG.sub(" ", bare).strip()
        if not bare:
            continue
        if bare.startswith("|") or bare.count("\t") >= 2:
            yield "log", bare
            continue
        if len("".join(_DIGITS.findall(bare))) > len("".join(_LETTERS.findall(bare))) or _KEY.match(bare):
            yield "log", bare
            continue
        if _CODE.search(bare) and not _STOP.search(bare.rstrip(";:")):
            yield "code", bare
            continue
        for part in _END.split(bare):
            part = part.strip()
            if part:
                yield ("sentence" if _STOP.search(part) else "loose"), part


def _share(top: int, words: int) -> float:
    return top / words if words else 0.0


def _phrase(words: list[str], count: Counter, k: int) -> float:
    """Share of the words that the most common run of k covers; 0 where it stays below PHRASE."""
    least = max(PHRASE_TIMES, PHRASE * len(words) / k)
    often = {w for w, c in count.items() if c >= least}  # all words of such a run are as common
    if not often:
        return 0.0
    runs = Counter(t for t in zip(*(words[i:] for i in range(k))) if often.issuperset(t)).most_common(1)
    return _share(k * runs[0][1], len(words)) if runs and runs[0][1] >= least else 0.0


def _key_phrase(words: list[str], count: Counter, function: frozenset[str]) -> tuple[float, list[str]]:
    """``share, others``: share of the words that the key phrase covers, and the words outside it.

    The key phrase is the run of 2 to LONGEST that covers most among those as common as :func:`_phrase`
    asks for, which begin and end in no function word. Without one all words are outside.
    """
    often = {w: c for w, c in count.items() if c >= max(PHRASE_TIMES, PHRASE * len(words) / LONGEST)}
    if function.issuperset(often):
        return 0.0, words
    best, size, phrase = 0, 0, ()
    for k in range(2, LONGEST + 1):
        least = max(PHRASE_TIMES, PHRASE * len(words) / k)
        runs = Counter(t for t in zip(*(words[i:] for i in range(k))) if t[0] in often and t[0] not in function and t[-1] not in function and all(w in often for w in t)).most_common(1)
        if runs and runs[0][1] >= least and runs[0][1] * k > best:
            best, size, phrase = runs[0][1] * k, k, runs[0][0]
    others, i, inside = [], 0, 0
    while i < len(words):
        if size and tuple(words[i : i + size]) == phrase:
            i, inside = i + size, inside + size
        else:
            others.append(words[i])
            i += 1
    return _share(inside, len(words)), others


def learned_words(pages: DataFrame) -> DataFrame:
    """``language, learned``: common words of languages without a list, from all documents' sentences; LEARNED a script at most.

    ``pages`` are :func:`document_features`. A row a script, and none for scripts with too few documents.
    """
    rows = pages.where(F.col("said_words").isNotNull() & (F.col("sentence_words") >= LEAST_WORDS))
    entries = F.map_entries("said_words")
    most = F.slice(F.reverse(F.array_sort(F.transform(entries, lambda x: F.struct(x["value"].alias("n"), x["key"].alias("w"))))), 1, COMMON)
    words = rows.select("language", F.explode(F.array_append(F.transform(most, lambda x: x["w"]), "")).alias("word"))  # the empty word counts the documents
    count = words.groupBy("language", "word").agg(F.count("*").alias("n"))
    order = W.partitionBy("language").orderBy((F.col("word") != ""), F.desc("n"), "word")
    best = count.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEARNED + 1)
    per = best.groupBy("language").agg(F.max(F.when(F.col("word") == "", F.col("n"))).alias("documents"), F.collect_list(F.struct("word", "n")).alias("all"))
    often = F.filter("all", lambda x: (x["word"] != "") & (x["n"] >= LEARN_SHARE * F.col("documents")))
    return per.where(F.col("documents") >= LEARN_FROM).select("language", F.transform(often, lambda x: x["word"]).alias("learned"))


def features(text: str) -> dict:
    """Numbers of one document; texts without words have zeros and the language ``und``.

    Sizes are in characters, a Chinese or Japanese one counting as three. Texts of languages
    without a list of function words have their words counted in ``loose_counts`` and ``said_words``.
    """
    word = _MARKED_WORD if _ANY_MARK.search(text) else _WORD
    size = dict.fromkeys(KINDS, 0)
    loose: list[str] = []
    said: list[str] = []
    lines: Counter = Counter()
    wide = not text.isascii()
    for kind, piece in pieces(text):
        size[kind] += len(piece) + (2 * len(_CJK.findall(piece)) if wide else 0)
        if kind == "loose":
            loose.append(piece)
        elif kind == "sentence":
            said.append(piece)
        else:
            continue
        lines[piece.lower()] += 1
    loose_text, said_text = " ".join(loose).lower(), " ".join(said).lower()
    loose_words, said_words = word.findall(loose_text), word.findall(said_text)
    language, _, _ = language_of_words(loose_words + said_words, loose_text + said_text)

    def grammar(words: list[str], t: str) -> tuple[int, int]:
        if language in FUNCTION_SIGNS:
            return sum(c in FUNCTION_SIGNS[language] for c in t), len(_CJK.findall(t))
        known = _SETS.get(language, frozenset())
        return sum(w in known for w in words), len(words)

    out: dict = {k: size[k] for k in KINDS}
    out["language"] = language if loose_words or said_words else "und"
    foreign = language.startswith("x-")
    out["loose_counts"], out["said_words"] = (dict(Counter(x)) if foreign else None for x in (loose_words, said_words))
    out["loose_separators"] = _share(len(_SEPARATOR.findall(loose_text)), len(loose_words))
    out["lines"], out["repeated_lines"] = sum(lines.values()), sum(lines.values()) - len(lines)
    for name, words, t in (("loose", loose_words, loose_text), ("sentence", said_words, said_text)):
        hits, n = grammar(words, t)
        out[f"{name}_words"], out[f"{name}_grammar"] = n, _share(hits, n)
        count = Counter(words)
        out[f"{name}_top"] = _share(sum(c for _, c in count.most_common(TOP_WORDS)), len(words))
        out[f"{name}_distinct"] = _share(len(count), len(words))
        out[f"{name}_phrase"] = max(_phrase(words, count, 2), _phrase(words, count, 3))
        # function words inside a key phrase are no sign of running text; signs are no words, and a
        # sentence that comes again as a whole is no key phrase
        key, others = 0.0, words
        if language in _SETS and words:
            once = word.findall(" ".join(dict.fromkeys(x.lower() for x in (loose if name == "loose" else said)))) if out["repeated_lines"] else words
            key, others = _key_phrase(once, Counter(once) if once is not words else count, _SETS[language])
        out[f"{name}_key"], out[f"{name}_outside"] = key, _share(*grammar(others, t)) if key else out[f"{name}_grammar"]
    return out


_COLUMNS = ", ".join(
    [f"{k} long" for k in KINDS]
    + ["language string", "loose_counts map<string,int>", "said_words map<string,int>", "loose_separators double", "lines long", "repeated_lines long"]
    + [f"{n}_{k}" for n in ("loose", "sentence") for k in ("words long", "grammar double", "top double", "distinct double", "phrase double", "key double", "outside double")]
)


def document_features(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """:func:`features` of each row; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pd.DataFrame([features(t if isinstance(t, str) else "") for t in pdf["text"]])
            yield pd.concat([pdf[["key"]].reset_index(drop=True), rows], axis=1)

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return spread(rows).mapInPandas(run, f"key {kind}, {_COLUMNS}")


def stuffed(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, share, kind`` of the documents most of whose text is keywords, links or tags.

    ``share`` is the part of such characters, ``kind`` is links or keywords, whichever is
    more. A language's documents with enough running text give, by their median share
    of function words, what loose words and sentences must fall short of, and by the medians
    of their repetition what must be passed where the language repeats itself much by nature. Null, empty and blank texts have no rows; rows that repeat each come out.
    """
    rows = materialized(document_features(df, text, key), "pages")
    rows = rows.join(F.broadcast(learned_words(rows)), "language", "left")  # a row a script
    part = lambda counts, words: F.coalesce(F.aggregate(
        F.map_values(F.map_filter(counts, lambda w, n: F.array_contains("learned", w))), F.lit(0), lambda a, n: a + n) / F.greatest(F.col(words), F.lit(1)), F.lit(0.0))
    for name, counts in (("loose", "loose_counts"), ("sentence", "said_words")):
        for column in (f"{name}_grammar", f"{name}_outside"):
            rows = rows.withColumn(column, F.when(F.col("learned").isNotNull(), part(counts, f"{name}_words")).otherwise(F.col(column)))
    rows = rows.withColumn("known", ~F.col("language").startswith("x-") | F.col("learned").isNotNull())
    running = F.col("sentence_words") >= 4 * LEAST_WORDS
    usual = rows.where(F.col("sentence_words") >= LEAST_WORDS).groupBy("language").agg(
        F.percentile_approx("sentence_grammar", 0.5, 1000).alias("usual"),
        F.percentile_approx(F.when(running, F.col("sentence_top")), 0.5, 1000).alias("top"),
        F.percentile_approx(F.when(running, F.col("sentence_distinct")), 0.5, 1000).alias("distinct"),
    )  # a row per language of FUNCTION_WORDS and FUNCTION_SIGNS, or script
    judged = rows.join(F.broadcast(usual), "language", "left").withColumn("usual", F.coalesce("usual", F.lit(USUAL_GRAMMAR)))
    top_share = F.greatest(F.lit(TOP_SHARE), F.coalesce(USUAL_PART * F.col("top"), F.lit(0.0)))
    distinct = F.least(F.lit(DISTINCT), F.coalesce(F.col("distinct") / USUAL_PART, F.lit(1.0)))
    # of a language that nothing is known of any words may be the grammar
    lacks = lambda c, part: ~F.col("known") | (F.col(c) < F.col("usual") * part)
    listed = ~F.col("language").startswith("x-")
    bare = listed & lacks("loose_grammar", GRAMMAR)
    again = (F.col("loose_top") >= top_share) & (F.col("loose_distinct") <= distinct) & lacks("loose_grammar", 1)
    # learned words are too few to tell a list by their absence alone
    tags = ~listed & (F.col("loose_separators") >= SEPARATORS) & lacks("loose_grammar", GRAMMAR)
    stuffed_loose = ((F.col("loose_words") >= LEAST_WORDS) & (bare | tags)) | (
        (F.col("loose_words") >= FEW_WORDS) & (again | (F.col("loose_phrase") >= PHRASE))
    )
    said_again = (F.col("lines") >= LEAST_LINES) & (F.col("lines") - F.col("repeated_lines") <= FEW_LINES)
    stuffed_said = (F.col("sentence_words") >= LEAST_WORDS) & (
        (lacks("sentence_grammar", GRAMMAR) & (F.col("sentence_top") >= top_share) & (F.col("sentence_distinct") <= distinct))
        | ((F.col("sentence_phrase") >= PHRASE) & lacks("sentence_grammar", PHRASE_GRAMMAR))
        | ((F.col("sentence_key") >= PHRASE) & lacks("sentence_outside", PHRASE_GRAMMAR))
        | ((F.col("sentence_key") >= MOST) & lacks("sentence_outside", 1))
        | (said_again & lacks("sentence_grammar", PHRASE_GRAMMAR))
    )
    words = F.when(stuffed_loose, F.col("loose")).otherwise(0) + F.when(stuffed_said, F.col("sentence")).otherwise(0)
    total = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    return (
        judged.select("key", (words / total).alias("words"), (F.col("link") / total).alias("links"), total.alias("total"))
        .where((F.col("total") > 0) & (F.col("words") + F.col("links") > MOST))
        .select(
            F.col("key").alias(key),
            F.round(F.col("words") + F.col("links"), 6).alias("share"),
            F.when(F.col("links") >= F.col("words"), "links").otherwise("keywords").alias("kind"),
        )
    )
