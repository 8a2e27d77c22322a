"""Sentence boundaries across languages and scripts: statistics learned unsupervised per language, then applied to each period."""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtspark.session import cut

# Breaks, marks and scripts.
_BREAK = r"(?>\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])"
_BLANK = regex.compile(_BREAK + r"(?:[^\S\n\r\x0b\x0c\x85\u2028\u2029]*+" + _BREAK + r")+")
_LIST_LINE = regex.compile(r"(?:(?<=[\n\r\x0b\x0c\x85\u2028\u2029])|\A)[^\S\n\r]*(?:[-*]|\d{1,3}\))[^\S\n\r][^\n\r\x0b\x0c\x85\u2028\u2029]*")
_STOP = regex.compile(r"[.!?…。！？｡．؟।॥]+")
_PAIR_MARK = regex.compile('["«»„“”「」『』()\\[\\]（）【】《》〈〉]')
_CLOSES = {"«": "»", "„": "“”", "“": "”", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉"}
_CLOSERS = set("\"»“”」』)]）】》〉'’")
_OPENERS = set("\"«„“「『([（【《〈¿¡")
#: Marks around a word that are none of its own.
_AROUND = ",;:!?…\"“”„«»()[]{}‘'’*"
_INVISIBLE = set("\u200b\u200c\u200d\u2060\ufeff\u00ad")
_STOPS, _FULL_STOPS, _CLEAR = set(".!?…。！？｡．؟।॥"), set("。！？｡"), set("!?！？؟।॥。｡")
_THAI_SPACE = regex.compile("(?<=\\p{Thai}[\u200b]?)[^\\S\\n\\r]+(?=[\u200b]?\\p{Thai})")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_INITIALS = regex.compile(r"\p{L}(?:\.\p{L})+")
_SCRIPTS = (("th", r"\p{Thai}"), ("hi", r"\p{Devanagari}"), ("ar", r"\p{Arabic}"), ("ru", r"\p{Cyrillic}"), ("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"))
_ANY_SCRIPT = regex.compile("|".join(f"(?P<{name}>{p}++)" for name, p in (("latin", r"\p{Latin}"), *_SCRIPTS)))
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_NO_CASE, _NO_SPACE = {"th", "hi", "ar", "ja", "zh"}, {"ja", "zh"}

#: Thresholds on log-likelihood ratios (7.88: one in 200 by chance), as in unsupervised period disambiguation.
ABBREVIATION, INNER, COLLOCATION, REPORTING, STARTER = 0.3, 7.88, 30.0, 15.0, 30.0
#: Words a language is told by, the most frequent of each.
TELLING_WORDS = 400
#: Entries of a learned model that are sent out at once; more make more passes over the corpus.
MODEL_ENTRIES = 300_000


@dataclass
class Model:
    """What the corpus taught, by language."""

    inner: set[tuple[str, str]] = field(default_factory=set)
    abbreviations: set[tuple[str, str]] = field(default_factory=set)
    collocations: set[tuple[str, str, str]] = field(default_factory=set)
    reporting: set[tuple[str, str]] = field(default_factory=set)
    starters: set[tuple[str, str]] = field(default_factory=set)
    words: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    unseen: dict[str, float] = field(default_factory=dict)


_CODE = regex.compile(r"[a-z]{2}(?:[-_].*)?", regex.DOTALL)
#: Marks as spaces, for words that tell a language.
_TO_SPACES = str.maketrans({c: " " for c in ",;:!?…\"“”„«»()[]{}<>/|*_=+-–—•¡¿0123456789"})


@functools.cache
def declared(lang: str | None) -> str:
    code = (lang or "").strip().lower()
    return code[:2] if _CODE.fullmatch(code) else ""


def telling_words(text: str) -> list[str]:
    """Words in lower case; one before a period may be an abbreviation and tells nothing."""
    return [w for w in text.lower().translate(_TO_SPACES).split() if w[-1] != "."]


def script_language(text: str) -> str:
    """Language told by script; '' for Latin or none."""
    if text.isascii():
        return ""
    plain = text.encode("ascii", "ignore")
    if 2 * (len(text) - len(plain)) <= len(plain.translate(None, _NO_LETTERS)):  # no script has half as many letters as Latin
        return ""
    counts = dict.fromkeys([name for name, _ in _SCRIPTS], 0) | {"latin": 0}
    for m in _ANY_SCRIPT.finditer(text):
        counts[m.lastgroup] += m.end() - m.start()
    latin = counts.pop("latin")
    if counts["ja"] and counts["ja"] * 8 >= counts["zh"]:
        counts["ja"] += counts["zh"]
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] * 2 > latin else ""


def language(text: str, lang: str | None, model: Model) -> str:
    """Told by script, else by the words the languages use (naive Bayes), else as declared."""
    by_script = script_language(text)
    if by_script or not model.unseen:
        return by_script or declared(lang)
    scores = {c: 0.0 for c in model.unseen}
    words, some = model.words, 0
    for word, n in Counter(telling_words(text)).items():
        if known := words.get(word):
            some += n
            for c, over in known:
                scores[c] += n * over
    if some:
        for c, least in model.unseen.items():
            scores[c] += some * least
    best = max(sorted(scores), key=scores.__getitem__)
    return best if any(scores.values()) else declared(lang)


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is a list line): what blank lines and list lines set apart."""
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        stop = m.start() if m else len(text)
        inner = at
        for line in _LIST_LINE.finditer(text, at, stop):
            if line.start() > inner:
                yield inner, line.start(), False
            yield line.start(), line.end(), True
            inner = line.end()
        if inner < stop:
            yield inner, stop, False
        at = m.end() if m else stop


def enclosed(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(open, close) of the outermost pairs of quotation marks and brackets; marks without a partner count for nothing."""
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    for m in _PAIR_MARK.finditer(text, start, end):
        c, i = m[0], m.start()
        if c == '"':
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), -1)
        else:
            at = next((k for k in range(len(stack) - 1, -1, -1) if c in _CLOSES.get(stack[k][0], "")), -1)
        if at >= 0:
            pairs.append((stack[at][1], i))
            del stack[at:]
        elif c in _CLOSES or c == '"':
            stack.append((c, i))
    pairs.sort()
    outer: list[tuple[int, int]] = []
    for a, b in pairs:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


@dataclass
class Stop:
    """A place where a sentence may end. kind: full, clear, dots, period or quote."""

    end: int
    kind: str
    type: str
    follows: str
    next: str
    resume: int


def stops(text: str, start: int, end: int) -> list[Stop]:
    pairs = enclosed(text, start, end)
    opens = {a for a, _ in pairs}
    found: list[Stop] = []
    k = 0
    for m in _STOP.finditer(text, start, end):
        i = m.start()
        while k < len(pairs) and pairs[k][1] < i:
            k += 1
        if k < len(pairs) and pairs[k][0] < i:
            continue
        mark = m[0]
        kind = "full" if set(mark) & _FULL_STOPS else "clear" if set(mark) & _CLEAR else "dots" if "…" in mark or len(mark) > 1 else "period"
        found.append(_stop(text, start, end, i, m.end(), kind, opens))
    for a, b in pairs:
        i = b - 1
        while i > a and (text[i].isspace() or text[i] in _INVISIBLE or text[i] in _CLOSERS):
            i -= 1
        if text[i] in _STOPS and i > a:
            found.append(_stop(text, start, end, i, b + 1, "quote", opens))
    found.sort(key=lambda s: s.end)
    return found


def _stop(text: str, start: int, end: int, mark: int, j: int, kind: str, opens: set[int]) -> Stop:
    while j < end and (text[j] in _INVISIBLE or (text[j] in _CLOSERS and j not in opens)):
        j += 1
    p = j
    while p < end and (text[p].isspace() or text[p] in _INVISIBLE):
        p += 1
    follows, word = _following(text, p, end, p > j)
    return Stop(j, kind, _type(text, start, mark) if kind in ("period", "dots") else "", follows, word, p)


def _following(text: str, p: int, end: int, spaced: bool) -> tuple[str, str]:
    """What comes next: end, start, lower, digit, or mark (a comma and the like)."""
    if p >= end:
        return "end", ""
    c = text[p]
    if c in _OPENERS or c == '"':
        return "start", ""
    if not spaced and not c.isalnum() and unicodedata.category(c)[0] == "P":
        return "mark", ""
    m = _WORD.search(text, p, end)
    if not m:
        return ("start" if spaced else "mark"), ""
    first = m[0][0]
    if c in ",;:،，、；：" and m.start() > p:
        return "mark", ""
    word = m[0].lower()
    return ("digit" if first.isdigit() else "lower" if first.islower() else "start"), word


_OPENING = regex.compile("[" + "".join(regex.escape(c) for c in sorted(_OPENERS)) + "]")
_FEW, _SOME = regex.compile(r"\d{1,2}"), regex.compile(r"\d{3,4}")


def _type(text: str, start: int, mark: int) -> str:
    """The word before a period, by which it is counted: numbers and initials in classes, 'z. b' with the part before."""
    near = max(start, mark - 48)
    parts = text[near:mark].rsplit(None, 1)
    while near > start and (len(parts) < 2 and not text[near:mark][:1].isspace()):  # a longer word: look further back
        near = max(start, near - 4 * (mark - near))
        parts = text[near:mark].rsplit(None, 1)
    word = parts[-1] if parts and mark > start and not text[mark - 1].isspace() else ""
    opened = 0
    for m in _OPENING.finditer(word):
        opened = m.end()
    a = mark - len(word) + opened
    kind = _kind(word[opened:])
    if kind and kind[0] != "#" and len(kind) <= 3 and a > start + 2:
        token = word[opened:]
        b = a - 1
        while b > start and text[b].isspace():
            b -= 1
        if text[b] == ".":
            c = b
            while c > start and text[c - 1].isalpha():
                c -= 1
            alone = c == start or text[c - 1].isspace() or text[c - 1] in _OPENERS
            if alone and 0 < b - c <= 2 and text[c:b].isupper() == token.isupper() and text[c:b].islower() == token.islower():
                return text[c:b].lower() + ". " + kind
    return kind


@functools.lru_cache(200_000)
def _kind(word: str) -> str:
    token = "".join(c for c in word if c not in _INVISIBLE).strip("'’-–—,;:%)")
    if not token:
        return ""
    if any(c.isdigit() for c in token):
        return "#1" if _FEW.fullmatch(token) else "#4" if _SOME.fullmatch(token) else "#x"
    if len(token) == 1 and token.isupper():
        return "#I"
    return unicodedata.normalize("NFC", token.lower())


def _edges(text: str, a: int, b: int, lang: str) -> tuple[str, str]:
    """How a clause begins and ends, for languages without case."""
    words = _WORD.findall(text[a:b])
    if not words:
        return "", ""
    return ("^" + words[0][0], words[-1][-1] + "$") if lang in _NO_SPACE else ("^" + words[0], words[-1] + "$")


def _clause_end(s: Stop, all_stops: list[Stop], k: int, end: int) -> int:
    for later in all_stops[k + 1 :]:
        if later.kind != "period" or later.follows in ("end", "start"):
            return later.end
    return end


def count(text: str, lang: str, into: Counter) -> None:
    """Add one text's evidence: (language, kind, a, b) -> n."""
    for start, end, is_list in blocks(text):
        if is_list:
            continue
        here = stops(text, start, end)
        quoted_before = False
        for k, s in enumerate(here):
            if s.kind == "period":
                into[lang, "dot", s.type, s.follows] += 1
                if s.follows == "start" and s.next:
                    into[lang, "pair", s.type, s.next] += 1
                if s.follows == "start" and s.next:
                    into[lang, "next", s.next, ""] += 1
            if s.kind in ("clear", "full", "quote") and s.follows == "start" and s.next:
                into[lang, "lead", s.next, ""] += 1
            if lang in _NO_CASE and s.kind in ("clear", "full", "quote") and s.follows in ("start", "digit", "lower"):
                for edge in _edges(text, s.resume, _clause_end(s, here, k, end), lang):
                    if edge:
                        into[lang, "edge", edge, "quote" if s.kind == "quote" else "other"] += 1


def count_words(tokens: Counter, lang: str, into: Counter) -> None:
    """Add the words among space-separated tokens: (language, 'word', word, '') where no period follows, and 'small' for those in lower case, for languages with case."""
    for token, n in tokens.items():
        word = token.strip(_AROUND)
        if word and not token.rstrip(_AROUND).endswith(".") and any(map(str.isalpha, word)):
            low = unicodedata.normalize("NFC", word.lower())
            into[lang, "word", low, ""] += n
            if lang not in _NO_CASE and word == word.lower():
                into[lang, "small", low, ""] += n


def ends(s: Stop, text: str, lang: str, model: Model, clause_end: int) -> bool:
    """Whether a sentence ends at this stop."""
    if s.follows == "end":
        return True
    if s.follows == "mark":
        return False
    if s.kind == "dots":
        return lang not in _NO_SPACE and s.follows == "start" and s.resume > s.end
    if s.kind == "quote":
        if s.follows == "lower" or (s.follows == "start" and lang in _NO_CASE and s.next and any((lang, e) in model.reporting for e in _edges(text, s.resume, clause_end, lang) if e)):
            return False
        return True
    if s.kind in ("full", "clear"):
        return s.kind == "full" or s.follows != "lower"
    if s.resume == s.end and s.next:
        return False
    if s.follows == "lower":
        return False
    if s.follows == "start" and s.resume > s.end and len(s.next) > 1 and (lang, s.next) in model.starters and s.type != "#1":
        return True
    if (lang, s.type) in model.inner:
        return False
    if (lang, "#I") in model.inner and (lang, s.type) not in model.abbreviations and _INITIALS.fullmatch(s.type):
        return False
    if (s.type and s.type[0] == "#") or (lang, s.type) in model.abbreviations:
        if s.follows == "digit":
            return s.type in ("#4", "#x", "#1") and (lang, s.type) not in model.inner and s.type != "#1"
        return (lang, s.type, s.next) not in model.collocations
    return True


def sentence_spans(text: str | None, code: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) by code point of each sentence in a text of the language `code`; null and blank texts have none."""
    if not text:
        return []
    spans: list[tuple[int, int]] = []
    for start, end, is_list in blocks(text):
        cuts = [start]
        if not is_list:
            here = stops(text, start, end)
            for k, s in enumerate(here):
                if ends(s, text, code, model, _clause_end(s, here, k, end) if s.kind == "quote" else 0):
                    cuts.append(s.end)
            pairs = None
            for m in _THAI_SPACE.finditer(text, start, end):
                pairs = enclosed(text, start, end) if pairs is None else pairs
                if not any(a < m.start() < b for a, b in pairs):
                    cuts.append(m.start())
        cuts = sorted({*cuts, end})
        for a, b in zip(cuts, cuts[1:], strict=False):
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                spans.append((a, b))
    return spans


def _counted(docs: DataFrame, add: Callable[[str, str | None, Counter, dict[str, Counter]], None]) -> DataFrame:
    """(lang, kind, a, b, n) summed over (text, lang) rows; `add` counts one text, words of a batch are counted together. Tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            tokens: dict[str, Counter] = {}
            for t, declared_as in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if t:
                    add(t, declared_as, seen, tokens)
            for lang, held in tokens.items():
                count_words(held, lang, seen)
            cols = list(zip(*seen, strict=True)) if seen else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*[pa.array(list(c), pa.string()) for c in cols], pa.array(list(seen.values()), pa.int64())], ["lang", "kind", "a", "b", "n"])

    counted = docs.mapInArrow(run, "lang string, kind string, a string, b string, n long")
    return counted.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """The evidence of the whole corpus, summed per language: (lang, kind, a, b, n).

    A first pass counts the Latin words of texts whose script or label names a language (kind 'label'), by which
    languages are told. The second counts every text under the language it will be cut by; what nothing tells is
    counted together under ''.
    """

    def labels(t: str, declared_as: str | None, into: Counter, _: dict[str, Counter]) -> None:
        if (code := script_language(t) or declared(declared_as)) and code not in _NO_SPACE:
            for word, n in Counter(telling_words(t)).items():
                into[code, "label", word, ""] += n

    source = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null")
    labelled = cut(_counted(source, labels))
    sent = docs.sparkSession.sparkContext.broadcast(model_of([tuple(r) for r in telling(labelled).collect()]))

    def evidence(t: str, declared_as: str | None, into: Counter, tokens: dict[str, Counter]) -> None:
        code = language(t, declared_as, sent.value)
        count(t, code, into)
        if code not in _NO_SPACE:
            tokens.setdefault(code, Counter()).update(t.split())

    return labelled.unionByName(_counted(source, evidence))


def _ln(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-12)))


def _ratio(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood ratio of k out of n against the share p."""
    share = F.coalesce(F.try_divide(k, n), F.lit(0.5))
    return 2 * (k * (_ln(share) - _ln(p)) + (n - k) * (_ln(1 - share) - _ln(1 - p)))


def findings(evidence: DataFrame) -> DataFrame:
    """(lang, what, a, b, weight): the entries of the model, chosen by log-likelihood ratios, all in DataFrame operations."""
    dots = evidence.where("kind = 'dot'").groupBy("lang", "a").pivot("b", ["end", "start", "lower", "digit", "mark"]).agg(F.sum("n")).na.fill(0)
    words = evidence.where("kind = 'word'").groupBy("lang", "a").agg(F.sum("n").alias("plain"))
    totals = words.groupBy("lang").agg(F.sum("plain").alias("tokens")).join(dots.groupBy("lang").agg(F.sum(F.col("end") + F.col("start") + F.col("lower")).alias("periods")), "lang", "full_outer").na.fill(0)
    types = dots.join(words, ["lang", "a"], "left").join(totals, "lang").na.fill(0)
    dotted = F.col("end") + F.col("start") + F.col("lower") + F.col("digit")
    plain = F.when(F.col("a").rlike(r"\. |^#"), 0).otherwise(F.col("plain"))
    length = F.greatest(F.length(F.regexp_replace("a", r"[. ]", "")), F.lit(1))
    inside = F.length(F.regexp_replace("a", r"[^.]", ""))
    p1 = F.least(F.greatest(F.col("periods") / F.greatest(F.col("tokens") + F.col("periods"), F.lit(1)), F.lit(1e-6)), F.lit(0.9))
    against = dotted * _ln(p1) + plain * _ln(1 - p1)
    dunning = -2 * (against - (dotted * F.log(F.lit(0.99)) + plain * F.log(F.lit(0.01))))
    types = types.withColumn("score", dunning * F.exp(-length) * (inside + 1) * F.pow(length.cast("double"), -F.least(10.0 * plain / F.greatest(dotted, F.lit(1)), F.lit(50.0)))).withColumn("special", F.col("a").startswith("#"))
    rare_initials = F.col("a").rlike(r"^\p{L}(\.\p{L})+$") & (F.col("end") == 0) & (F.col("start") < 20) & (F.col("lower") < 5)
    types = types.withColumn("abbreviation", F.col("special") | ((F.col("score") >= ABBREVIATION) & ~rare_initials))
    base = types.where(~F.col("abbreviation")).groupBy("lang").agg((F.sum("end") / F.greatest(F.sum(F.col("end") + F.col("start")), F.lit(1))).alias("final"))
    types = types.join(base, "lang", "left").withColumn("final", F.least(F.greatest(F.coalesce("final", F.lit(0.2)), F.lit(0.05)), F.lit(0.6)))
    n = F.col("end") + F.col("start")
    inner = F.col("abbreviation") & (n > 0) & (F.try_divide(F.col("end"), n) < F.col("final") / 2) & (_ratio(F.col("end").cast("double"), n.cast("double"), F.col("final")) > INNER)
    none = F.lit("")
    types = cut(types.withColumn("inner", inner).select("lang", "a", "score", "abbreviation", "inner"))
    out = types.where("abbreviation").select("lang", F.when(F.col("inner"), "inner").otherwise("abbreviation").alias("what"), "a", none.alias("b"), F.col("score").alias("weight"))

    pairs = evidence.where("kind = 'pair'").select("lang", F.col("a").alias("type"), F.col("b").alias("next"), "n")
    nexts = evidence.where("kind = 'next'").select("lang", F.col("a").alias("next"), F.col("n").alias("n_next"))
    all_next = nexts.groupBy("lang").agg(F.sum("n_next").alias("n_all"))
    of_type = pairs.groupBy("lang", "type").agg(F.sum("n").alias("n_type"))
    lead = evidence.where("kind = 'lead'").select("lang", F.col("a").alias("next"), F.col("n").alias("n_lead"))
    all_lead = lead.groupBy("lang").agg(F.sum("n_lead").alias("all_lead"))
    pairs = pairs.join(types.where("abbreviation and not inner").select("lang", F.col("a").alias("type")), ["lang", "type"]).join(of_type, ["lang", "type"]).join(nexts, ["lang", "next"]).join(all_next, "lang").join(lead, ["lang", "next"], "left").join(all_lead, "lang", "left")
    share = F.least((F.col("n_next") - F.col("n") + 0.5) / F.greatest(F.col("n_all") - F.col("n_type"), F.lit(1)), F.lit(0.99))
    starts_often = F.coalesce(F.try_divide(F.col("n_lead"), F.col("all_lead")), F.lit(0.0))
    # a word that starts sentences elsewhere is no second half of a collocation
    together = (F.col("n") >= 3) & (F.coalesce("n_lead", F.lit(0)) < F.col("n")) & (F.try_divide(F.col("n"), F.col("n_type")) > 3 * share) & (F.try_divide(F.col("n"), F.col("n_type")) > 3 * starts_often) & (_ratio(F.col("n").cast("double"), F.col("n_type").cast("double"), share) > COLLOCATION)
    out = out.unionByName(pairs.where(together).select("lang", F.lit("collocation").alias("what"), F.col("type").alias("a"), F.col("next").alias("b"), F.lit(0.0).alias("weight")))

    # a word that begins sentences after clear ends far more often than it occurs, and isn't a name: it occurs in lower case too
    small = evidence.where("kind = 'small'").select("lang", F.col("a").alias("next"), F.col("n").alias("n_small"))
    often = lead.join(words.select("lang", F.col("a").alias("next"), "plain"), ["lang", "next"]).join(small, ["lang", "next"]).join(all_lead, "lang").join(totals.select("lang", "tokens"), "lang")
    rate = F.least(F.greatest(F.try_divide(F.col("all_lead"), F.col("tokens")), F.lit(1e-6)), F.lit(0.9))
    n_all = F.greatest(F.col("plain"), F.col("n_lead"))
    starts = (F.col("n_small") >= 0.05 * n_all) & (F.col("n_lead") / n_all > 2 * rate) & (_ratio(F.col("n_lead").cast("double"), n_all.cast("double"), rate) > STARTER)
    out = out.unionByName(often.where(starts).select("lang", F.lit("starter").alias("what"), F.col("next").alias("a"), none.alias("b"), F.lit(0.0).alias("weight")))

    edges = evidence.where("kind = 'edge'").groupBy("lang", "a").pivot("b", ["quote", "other"]).agg(F.sum("n")).na.fill(0)
    sums = edges.groupBy("lang", F.col("a").startswith("^").alias("head")).agg(F.sum("quote").alias("q"), F.sum("other").alias("o"))
    edges = edges.withColumn("head", F.col("a").startswith("^")).join(sums, ["lang", "head"])
    seen = F.col("quote") + F.col("other")
    rate = F.least(F.greatest(F.coalesce(F.try_divide(F.col("q"), F.col("q") + F.col("o")), F.lit(0.5)), F.lit(0.01)), F.lit(0.99))
    reports = (F.col("quote") >= 5) & (F.try_divide(F.col("quote"), seen) > 0.85) & (F.try_divide(F.col("quote"), F.col("q")) > 0.02) & (_ratio(F.col("quote").cast("double"), seen.cast("double"), rate) > REPORTING)
    out = out.unionByName(edges.where(reports).select("lang", F.lit("reporting").alias("what"), "a", none.alias("b"), F.lit(0.0).alias("weight")))

    return out.unionByName(telling(evidence))


def telling(evidence: DataFrame) -> DataFrame:
    """The model's entries (lang, what, a, b, weight) by which the language of a Latin text is told."""
    none = F.lit("")
    latin = evidence.where("kind = 'label'").where(F.col("a").rlike(r"^\p{IsLatin}+$")).groupBy("lang", "a").agg(F.sum("n").alias("plain"))
    size = latin.groupBy("lang").agg(F.sum("plain").alias("size"))
    top = Window.partitionBy("lang").orderBy(F.col("plain").desc(), "a")
    frequent = latin.withColumn("k", F.row_number().over(top)).where(F.col("k") <= TELLING_WORDS).select("a").distinct()
    told = latin.join(frequent, "a").join(size.where("size >= 200"), "lang").select("lang", F.lit("word").alias("what"), "a", none.alias("b"), F.log(F.col("plain") / F.col("size")).alias("weight"))
    floor = size.where("size >= 200").select("lang", F.lit("unseen").alias("what"), none.alias("a"), none.alias("b"), F.log(0.05 / F.col("size")).alias("weight"))
    return told.unionByName(floor)


def model_of(rows: list) -> Model:
    model = Model()
    for lang, what, a, b, weight in rows:
        if what in ("inner", "abbreviation"):
            (model.inner if what == "inner" else model.abbreviations).add((lang, a))
        elif what == "collocation":
            model.collocations.add((lang, a, b))
        elif what == "reporting":
            model.reporting.add((lang, a))
        elif what == "word":
            model.words.setdefault(a, []).append((lang, weight))
        elif what == "unseen":
            model.unseen[lang] = weight
        elif what == "starter":
            model.starters.add((lang, a))
    # a word's weight over that of an unseen one: a text's score is a sum over the words it has
    model.words = {w: [(c, x - model.unseen[c]) for c, x in known if c in model.unseen] for w, known in model.words.items()}
    return model


def corpus_sentences(docs: DataFrame, key: str, text: str, lang: str, evidence: DataFrame | None = None) -> DataFrame:
    """(key, start_pos, end_pos): every sentence of every text as a span of code points, without white space at its ends.

    One pass counts the words of labelled texts, one the evidence (both pre-aggregated per task), DataFrame operations
    choose the model's entries, a last pass cuts the texts where they lie; documents are never shuffled. Null, empty and blank texts have no rows, repeated
    rows repeat theirs, a null or wrong language costs only accuracy. The model is sent out whole after a check of its
    size: it holds entries that pass a significance test, not the vocabulary. A larger one goes out in groups of
    languages of at most MODEL_ENTRIES entries, with one pass over the corpus each.
    """
    spark = docs.sparkSession
    found = cut(findings(cut(learn(docs, text, lang)) if evidence is None else evidence))
    told = [tuple(r) for r in found.where("what in ('word', 'unseen')").collect()]
    groups: list[list[str]] = [[]]
    size = 0
    for row in found.where("what not in ('word', 'unseen')").groupBy("lang").count().orderBy("lang").collect():
        if size + row["count"] > MODEL_ENTRIES and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append(row["lang"])
        size += row["count"]
    named = {c for g in groups for c in g}
    key_type = docs.schema[key].dataType.simpleString()

    def one(codes: list[str], rest: bool) -> DataFrame:
        rows = [tuple(r) for r in found.where(F.col("lang").isin(codes) & ~F.col("what").isin("word", "unseen")).collect()] if codes else []
        sent, here = spark.sparkContext.broadcast(model_of(told + rows)), set(codes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for batch in batches:
                take, starts, stops_ = [], [], []
                for i, (t, code) in enumerate(zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
                    told_as = language(t, code, model) if t else ""
                    if told_as in here or (rest and told_as not in named):
                        for a, b in sentence_spans(t, told_as, model):
                            take.append(i)
                            starts.append(a)
                            stops_.append(b)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(take, pa.int64())), pa.array(starts, pa.int32()), pa.array(stops_, pa.int32())], ["key", "start_pos", "end_pos"])

        return source.mapInArrow(run, f"key {key_type}, start_pos int, end_pos int")

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null")
    passes = [one(codes, k == 0) for k, codes in enumerate(groups)]
    return reduce(DataFrame.unionByName, passes).withColumnRenamed("key", key)
