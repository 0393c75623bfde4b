"""Personal information in free text, found by bootstrapping over contexts.

Shapes that leave no doubt (a number with a country code, an id after its label,
a street with its type) and names whose parts are in a given lexicon are the
seeds. The words around seeds make patterns; a pattern's confidence is the share
of its fillings that are seeds. Confident patterns then vouch for fillings whose
shape alone says little, and for name parts that the lexicon lacks, which serve
as seeds in the next round. Scoring runs over the table of candidates and their
patterns, pre-aggregated by pattern, so a pattern or a name that fills a third of
all rows costs no more than another.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import cut

KINDS = ("email", "phone", "id_number", "address", "name")

# Written forms of the kinds, as used in the public.
_L = r"A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ̀-ͯ"
_U = "[A-ZÀ-ÖØ-Þ" + "".join(chr(c) for c in [*range(0x100, 0x250), *range(0x1E00, 0x1F00)] if chr(c).isupper()) + "]"
_AT = r"(?:@|\s?[\[({]\s?at\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
EMAIL = re.compile(rf"(?<![{_L}0-9._%+-])[{_L}0-9][{_L}0-9._%+-]*{_AT}[{_L}0-9-]+(?:{_DOT}[{_L}0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![{_L}0-9-])", re.I)
SPOKEN = re.compile(rf"(?<![{_L}0-9._%+-])[{_L}0-9][{_L}0-9._%+-]* at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+(?![{_L}0-9-])", re.I)
_SIGN = re.compile(r"@|[\[({]\s?at\s?[\])}]", re.I)
_GLUED = re.compile(r"@(?:[a-z0-9-]+\.)+?[a-z]{2,}(?=\.?[A-Z][a-z])")  # a domain in small letters and the sentence that follows without a blank
_REMOTE = re.compile(r":(?!\s|$)[\w~/.-]+/|:[\w.-]+\.git")
PHONE = re.compile(
    r"""(?<![A-Za-z0-9_.,/+-])(?:
      (?:\+1[ .-]?|1[ .-])?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}
    | \+1\d{10}
    | (?:\+44[ ]?(?:\(0\)[ ]?)?|0044[ ]?|0)(?:20[ ]?\d{4}[ ]?\d{4}|1\d{3}[ ]\d{6}|7\d{3}[ ]\d{6})
    | (?:\+33[ ]?(?:\(0\)[ ]?)?|0033[ ]?|0)[1-9](?:[ .-]?\d{2}){4}
    | (?:\+49[ ]?(?:\(0\)[ ]?)?|0049[ ]?|0)[1-9]\d{1,3}[ /-]?\d{4,5}[ -]?\d{3}
    | (?:\+34[ ]?|0034[ ]?)\d{3}(?:[ ]?\d{3}){2}
    | \+\d{8,15}
    )(?![0-9a-z_]|[A-Z](?![a-z])|[-.]\d)""",
    re.X,
)
ID_NUMBER = re.compile(
    r"""(?<![A-Za-z0-9_./-])(?:
      \d{3}-\d{2}-\d{4} | \d{3}[ ]\d{2}[ ]\d{4} | \d{9}
    | \d{2,3}/\d{2,3}/\d{4,5}
    | \d{6}[-+]\d{4}
    | [A-Z]{2}\d{7} | [A-Z]\d[ ]?\d{6} | [A-Z]\d{2}[A-Z]\d{5} | [A-Z]\d{8} | \d{8}[A-Z]
    )(?![0-9A-Za-z_]|[-/]\d)""",
    re.X,
)
ID_LABEL = re.compile(
    r"(?i)(?:\bssn|\bsocial security(?: (?:number|no\.?))?|\btax (?:id|number)|\bnational id|\bpassport|\bausweis|\breisepass|\bpersonalausweis|\bsteuer-?id|\bdni|\bnif|\bid card|\bidentity (?:card|number)|\binsee|\bnir|\bpasseport|\bpasaporte)"
    r"(?:[ -]?(?:no|nr|number|num|nummer|n°|nº)\.?)?:?[ ]?$"
)
_CAP = rf"{_U}[{_L}'’]*(?:-[{_L}'’]+)*"
_END = rf"(?![{_L}0-9_])"
_SHORTENED = r"(?:(?<=Ave)|(?<=Blvd)|(?<= St)|(?<= Rd)|(?<= Dr)|(?<= Ln)|(?<= Ct))"
STREET = re.compile(
    rf"""(?<![{_L}0-9_.,/-])(?:
      \d{{1,5}}[a-zA-Z]?[ ](?:{_CAP}[ ]){{1,3}}(?:Street|Road|Lane|Avenue|Drive|Court|Boulevard|Terrace|Crescent|Close|Square|Place|Way|St|Rd|Ln|Ave|Dr|Ct|Blvd){_END}(?:{_SHORTENED}\.(?=[ ]?[,|\n;]|[ ]\d|[ ]?$|[ ][a-z]))?
    | \d{{1,4}}(?:[ ]?(?:bis|ter|quater))?,?[ ](?:rue|avenue|boulevard|chemin|place|impasse|quai|allée|cours|route|square)[ ](?:(?:de[ ]la|de[ ]l['’]|du|des|de|d['’])[ ]?)?{_CAP}(?:[ ]{_CAP})*{_END}
    | (?:Calle|C/|Avenida|Avda\.|Plaza|Paseo|Camino|Ronda|Carrera)[ ](?:(?:de[ ]la|de[ ]los|de[ ]las|del|de)[ ])?{_CAP}(?:[ ]{_CAP})*,?[ ]\d{{1,4}}[a-z]?{_END}
    | {_U}[{_L}]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer)[ ]\d{{1,4}}(?:[ ]?[a-z])?{_END}
    | {_CAP}[ ](?:Gasse|Straße|Str\.|Weg|Allee|Platz|Ring|Damm|Ufer)[ ]\d{{1,4}}(?:[ ]?[a-z])?{_END}
    )""",
    re.X,
)
LOOSE_STREET = re.compile(rf"(?<![{_L}0-9_./-])(?!(?:Adresse|Address|Anschrift|Dirección)[ ])(?:{_CAP}[ ]){{1,4}}\d{{1,4}}[a-z]?(?=,[ ]\d|[ ]?[|\n;])")
# The words that STREET needs.
STREET_WORDS = (
    "Street Road Lane Avenue Drive Court Boulevard Terrace Crescent Close Square Place Way St Rd Ln Ave Dr Ct Blvd rue avenue boulevard chemin place impasse quai allée cours route square "
    "Calle C/ Avenida Avda. Plaza Paseo Camino Ronda Carrera straße strasse str. weg gasse allee platz ring damm ufer Gasse Straße Str. Weg Allee Platz Ring Damm Ufer"
).split()
_DIGITS = re.compile(r"\d[\d ()./+A-Z-]*")
_DIGIT = re.compile(r"\d")
_HOUSE = re.compile(r"\d{1,4}[a-z]?(?=,[ ]\d|[ ]?[|\n;])")
WORD = re.compile(rf"[{_L}]+(?:[-'’][{_L}]+)*")
LETTERS = frozenset(c for c in map(chr, range(0x1F00)) if re.match(f"[{_L}]", c))
_CAPITAL = re.compile(rf"{_U}(?<![{_L}].)(?<![{_L}][-'’].)[{_L}]*(?:[-'’][{_L}]+)*")
_BEFORE = re.compile(rf"{_U}(?<![{_L}].)(?<![{_L}][-'’].)[{_L}]+(?:[-'’][{_L}]+)* $")
_TOKEN = re.compile(rf"[{_L}_]+|\d+|[^\s]|\n")
STOPS = frozenset(".?!。！？")
SHAPE = "|shape|"
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

CANDIDATE = "doc_id long, kind string, start int, end int, surface string, strong boolean, given string, family string, patterns array<bigint>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string()), ("strong", pa.bool_()), ("given", pa.string()), ("family", pa.string()), ("patterns", pa.list_(pa.int64()))])


Lexicon = dict[str, set[str]]


def fold(word: str) -> str:
    return unicodedata.normalize("NFC", word).lower()


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, also with signs spelled out; neither remotes of repositories nor package versions."""
    taken = 0
    found = []
    for sign in _SIGN.finditer(text):
        at = sign.start()
        if at >= taken:
            at -= at > 0 and text[at - 1].isspace()
            while at > taken and (text[at - 1].isalnum() or text[at - 1] in "._%+-" or unicodedata.combining(text[at - 1])):
                at -= 1
            m = EMAIL.search(text, at, sign.end() + 320)
            if m and m.start() < sign.start():
                found.append(m)
                taken = m.end()
    low = text.lower() if " dot " in text or " DOT " in text else ""
    if " at " in low and " dot " in low:
        found += SPOKEN.finditer(text)
    for m in found:
        if not _REMOTE.match(text, m.end()) and not text[max(0, m.start() - 3) : m.start()].endswith("://"):
            glued = _GLUED.search(text, m.start(), m.end() + 2)
            yield m.start(), glued.end() if glued else m.end()


def numbers(text: str) -> Iterator[tuple[str, re.Match]]:
    """(kind, match) of phone and identity numbers: only stretches with seven digits at least are looked at."""
    last, done = -1, set()
    for m in _DIGITS.finditer(text):
        s, e = m.span()
        if e - s >= 7 and sum(c.isdigit() for c in m.group()) >= 7:
            for kind, form in (("phone", PHONE), ("id_number", ID_NUMBER)):
                for x in form.finditer(text, max(0, s - 3, last), e + 3):
                    if (kind, x.start()) not in done:
                        done.add((kind, x.start()))
                        yield kind, x
            last = e - 3


def streets(text: str) -> Iterator[re.Match]:
    """Street addresses, looked for around the words that make one."""
    to, n = 0, len(text)
    for end, _ in _street_words().iter(text):
        if end >= to and (end + 1 == n or not (text[end + 1].isalnum() or text[end + 1] == "_")) and _DIGIT.search(text, max(0, end - 120), end + 300):
            at, limit = max(0, to, end - 300), end + 300
            while at > to and (text[at - 1] in LETTERS or text[at - 1] in "'’-"):
                at -= 1
            while m := STREET.search(text, at, limit):
                at = m.start() + 1
                if limit < n and m.end() > limit - 20:
                    m = STREET.match(text, m.start())
                if m:
                    yield m
                    at = to = m.end()


def loose_streets(text: str) -> Iterator[re.Match]:
    """Capitalised words before a number that ends a line or stands before a postcode."""
    to = 0
    for n in _HOUSE.finditer(text):
        s = n.start()
        if s >= to and s > 1 and text[s - 1] == " " and (text[s - 2].isalpha() or text[s - 2] in "'’" or unicodedata.combining(text[s - 2])):
            at = max(to, s - 200)
            while at > to and (text[at - 1] in LETTERS or text[at - 1] in "'’-"):
                at -= 1
            m = LOOSE_STREET.search(text, at, n.end() + 4)
            if m:
                yield m
                to = m.end()


def _automaton(words: Iterable[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _street_words() -> ahocorasick.Automaton:
    return _automaton(STREET_WORDS)


def holds_word(words: ahocorasick.Automaton, text: str) -> bool:
    """Whether one of the words stands in a text as a whole word or as a part between hyphens."""
    if not len(words):
        return False
    n = len(text)
    return any((e + 1 == n or text[e + 1] not in LETTERS) and (e - w < 0 or text[e - w] not in LETTERS) for e, w in words.iter(text))


def _context(text: str, start: int, end: int, kind: str) -> list[str]:
    """The patterns around a span: two tokens before, two after, and one on either side, none of them beyond the end of a sentence; numbers and addresses are generalised."""
    left, right = text[max(0, start - 60) : start], text[end : end + 60]
    if "@" in left or "at" in left:
        left = EMAIL.sub(" \x01 ", left)
    else:
        left = left[-30:]
    if "@" in right or "at" in right:
        right = EMAIL.sub(" \x01 ", right)
    else:
        right = right[:30]
    before, after = _TOKEN.findall(left), _TOKEN.findall(right)
    # a token that the window cuts is left out
    before = before[len(before) > 0 and start > len(left) and left.startswith(before[0]) and len(before[0]) > 1 :][-2:]
    after = after[: len(after) - (len(after) > 0 and end + len(right) < len(text) and right.endswith(after[-1]) and len(after[-1]) > 1)][:2]
    norm = lambda ts: ["9" if t[0].isdigit() else t.lower() for t in ts]
    b, a = norm(before), norm(after)
    if a and a[0] in STOPS:
        a = a[:1]  # what another sentence begins with says nothing of the span
    if b and b[-1] in STOPS:
        b = b[-1:]
    out = [f"{kind}|{' '.join(b[-1:])}|{' '.join(a[:1])}"] if b and a and not (b[-1] == "\n" and a[0] == "\n") else []
    if len(b) == 2 and any(len(t) > 1 for t in b):
        out.append(f"{kind}|{' '.join(b)}|*")
    if len(a) == 2 and (any(len(t) > 1 for t in a) or "\x01" in a):
        out.append(f"{kind}|*|{' '.join(a)}")
    if len(b) == 2 and len(a) == 2:
        out.append(f"{kind}|{' '.join(b)}|{' '.join(a)}")
    if kind != "name":
        shape = re.sub(r"\d", "9", text[start:end])
        out.append(f"{kind}{SHAPE}{re.sub('9+', '9', shape) if kind == 'address' else re.sub('[A-Z]', 'A', shape)}")
    return out


def name_spans(text: str, likely: Callable[[str], bool] = lambda _: True) -> Iterator[tuple[int, int, str | None, str, bool]]:
    """(start, end, given, family, capitalised) of every span with the form of a full name; an initial in place of the given name leaves it None.

    Spans whose first whole word isn't ``likely`` are passed over; so are those after an initial whose family isn't.

    Forms: given family, given I. family, I. family, family, given and family, given I.
    Each pair of neighbouring words is offered in all roles that its form allows.
    """
    words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    for i, (s, e, w) in enumerate(words):
        if len(w) == 1 and w.isupper() and text[e : e + 2] == ". " and i + 1 < len(words) and words[i + 1][0] == e + 2:
            s2, e2, w2 = words[i + 1]
            if len(w2) > 1 and likely(w2) and (i == 0 or not (words[i - 1][1] == s - 1 and text[s - 1] == " " and words[i - 1][2][0].isupper() and len(words[i - 1][2]) > 1 and likely(words[i - 1][2]))):
                yield s, e2, None, w2, w2[0].isupper()
        if len(w) < 2 or i + 1 >= len(words) or not likely(w):
            continue
        s2, e2, w2 = words[i + 1]
        if s2 == e + 1 and text[e] == " ":
            if len(w2) > 1:
                yield s, e2, w, w2, w[0].isupper() and w2[0].isupper()
            elif w2.isupper() and text[e2 : e2 + 2] == ". " and i + 2 < len(words) and words[i + 2][0] == e2 + 2 and len(words[i + 2][2]) > 1:
                s3, e3, w3 = words[i + 2]
                yield s, e3, w, w3, w[0].isupper() and w3[0].isupper()
        elif s2 == e + 2 and text[e : e + 2] == ", " and len(w2) > 1:
            last = e2
            if i + 2 < len(words) and words[i + 2][0] == e2 + 1 and len(words[i + 2][2]) == 1 and words[i + 2][2].isupper() and text[e2] == " " and text[words[i + 2][1] : words[i + 2][1] + 1] == ".":
                last = words[i + 2][1] + 1
            yield s, last, w2, w, w[0].isupper() and w2[0].isupper()


def capitalised_spans(text: str) -> Iterator[tuple[int, int, str | None, str, bool]]:
    """``name_spans`` whose words are all capitalised, found from these words on."""
    for m in _CAPITAL.finditer(text):
        s, e = m.span()
        nxt = text[e : e + 3]
        if e - s == 1:
            if nxt[:2] == ". " and nxt[2:].isalpha():
                w = WORD.match(text, e + 2)
                if w and w.end() - w.start() > 1 and w.group()[0].isupper():
                    before = _BEFORE.search(text, max(0, s - 80), s)
                    if not before:
                        yield s, w.end(), None, w.group(), True
        elif nxt[:1] == " " and nxt[1:2].isalpha():
            w = WORD.match(text, e + 1)
            if not w or not w.group()[0].isupper():
                continue
            if w.end() - w.start() > 1:
                yield s, w.end(), m.group(), w.group(), True
            elif text[w.end() : w.end() + 2] == ". ":
                f = WORD.match(text, w.end() + 2)
                if f and f.end() - f.start() > 1 and f.group()[0].isupper():
                    yield s, f.end(), m.group(), f.group(), True
        elif nxt[:2] == ", " and nxt[2:].isalpha():
            w = WORD.match(text, e + 2)
            if w and w.end() - w.start() > 1 and w.group()[0].isupper():
                i = WORD.match(text, w.end() + 1) if text[w.end() : w.end() + 1] == " " else None
                initial = i and i.end() - i.start() == 1 and i.group().isupper() and text[i.end() : i.end() + 1] == "."
                yield s, i.end() + 1 if initial else w.end(), w.group(), m.group(), True


def candidates(text: str, lexicon: Lexicon, words: ahocorasick.Automaton) -> Iterator[tuple]:
    """(kind, start, end, strong, given, family) of a text; words are those of the lexicon in small letters."""
    taken: list[tuple[int, int]] = []
    for s, e in emails(text):
        taken.append((s, e))
        yield "email", s, e, True, None, None
    free = lambda s, e: all(e <= a or s >= b for a, b in taken)
    for kind, m in numbers(text):
        if free(*m.span()):
            t = m.group()
            if kind == "phone":
                yield kind, m.start(), m.end(), t[0] == "+" or t.startswith("00") or t[0] == "(" or "(" in t, None, None
            else:
                yield kind, m.start(), m.end(), bool(ID_LABEL.search(text[max(0, m.start() - 40) : m.start()])), None, None
    sure = []
    for m in streets(text):
        if free(*m.span()):
            sure.append(m.span())
            yield "address", m.start(), m.end(), True, None, None
    for m in loose_streets(text):
        if free(*m.span()) and all(m.end() <= a or m.start() >= b for a, b in sure):
            yield "address", m.start(), m.end(), False, None, None
    spans = name_spans(text, lambda w: w[0].isupper() or w in lexicon) if holds_word(words, text) else capitalised_spans(text)
    for s, e, given, family, capitalised in spans:
        g, f = given and fold(given), fold(family)
        known = "given" in lexicon.get(g, ()), "family" in lexicon.get(f, ())
        if (capitalised or all(known)) and free(s, e):
            yield "name", s, e, all(known), g, f


def pattern_id(pattern: str) -> int:
    """A pattern as a number of 63 bits, odd for shapes; tables of patterns hold these alone."""
    return xxhash.xxh64_intdigest(pattern) >> 2 << 1 | (SHAPE in pattern)


def _find(lexicon: Lexicon):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _automaton(lexicon)
        for b in batches:
            for part in range(0, b.num_rows, 1000):
                p, rows = b.slice(part, 1000), []
                for i, text in zip(p["doc_id"].to_pylist(), p["text"].to_pylist(), strict=True):
                    for kind, s, e, strong, g, f in candidates(text, lexicon, words):
                        before = s
                        if kind == "id_number" and strong:
                            label = ID_LABEL.search(text[max(0, s - 40) : s])
                            before = max(0, s - 40) + label.start()
                        around = [] if kind == "email" else _context(text, s, e, kind) if before == s else _context(text[:before] + text[s:], before, before + e - s, kind)
                        rows.append((i, kind, s, e, text[s:e], strong, g, f, [pattern_id(x) for x in around]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 9, _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def seed_lexicon(name_lexicon: DataFrame) -> Lexicon:
    """folded token -> its kinds; the given lexicon is a list of seeds, made by hand, and fits into every worker."""
    out: dict[str, set[str]] = {}
    for r in name_lexicon.where("token is not null and token_kind in ('given', 'family')").select("token", "token_kind").distinct().collect():
        out.setdefault(fold(r["token"]), set()).add(r["token_kind"])
    return out


def confident_patterns(found: DataFrame, confidence: float, support: int, shape_confidence: float = 0.6) -> DataFrame:
    """(pattern) that seeds fill often enough; found has doc_id, surface, seed and patterns.

    Equal fillings count once; a pattern needs ``support`` different fillings that
    are seeds. The written shape of a filling is a pattern too, and needs
    ``shape_confidence``, as it holds for all contexts.
    """
    each = found.select(F.xxhash64("surface").alias("surface"), "seed", F.explode("patterns").alias("pattern"))
    by_filling = each.groupBy("pattern", "surface").agg(F.max(F.col("seed").cast("int")).alias("seed"))
    stats = by_filling.groupBy("pattern").agg(F.sum("seed").alias("seeds"), F.count("*").alias("fillings"))
    return stats.where((F.col("seeds") >= support) & (F.col("seeds") >= F.when(F.col("pattern") % 2 == 1, shape_confidence).otherwise(confidence) * F.col("fillings"))).select("pattern")


def _vouched(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end) of the candidates that some pattern vouches for."""
    return found.select("doc_id", "kind", "start", "end", F.explode("patterns").alias("pattern")).join(patterns, "pattern", "left_semi").select("doc_id", "kind", "start", "end").distinct()


def accepted_numbers(found: DataFrame, rounds: int = 2, confidence: float = 0.2, support: int = 3) -> DataFrame:
    """The candidates of other kinds than names that are strong or vouched for: (doc_id, kind, start, end, surface)."""
    keys = ["doc_id", "kind", "start", "end"]
    own = found.where("kind <> 'name'").withColumn("seed", F.col("strong"))
    for _ in range(rounds):
        good = confident_patterns(own, confidence, support)
        vouched = _vouched(own.where("not strong"), good).withColumn("ok", F.lit(True))
        own = cut(own.drop("ok").join(vouched, keys, "left").withColumn("seed", F.col("strong") | F.coalesce("ok", F.lit(False))))
    return own.where("seed").select(*keys, "surface")


def learned_names(found: DataFrame, lexicon: DataFrame, rounds: int = 3, confidence: float = 0.3, support: int = 3, share: float = 0.5, least_docs: int = 2) -> tuple[DataFrame, DataFrame]:
    """(token, role) of the name parts known in the end, those of the lexicon and those that confident patterns bring; and (doc_id, start, end, surface) of the names with other new parts that a confident pattern vouches for where they stand.

    A new part must fill confident patterns in ``share`` of the documents in which
    it stands in a name's form at all. To be known in other places too, it must do
    so in ``least_docs`` documents.
    """
    names = found.where("kind = 'name'").select("doc_id", "start", "end", "surface", "given", "family", "patterns")
    known = lexicon
    for k in range(rounds):
        role = lambda r: known.where(F.col("role") == r).select(F.col("token").alias(r), F.lit(True).alias(f"has_{r}"))
        marked = names.join(role("given"), "given", "left").join(role("family"), "family", "left")
        full = F.col("has_family").isNotNull() & (F.col("has_given").isNotNull() | F.col("given").isNull())
        good = confident_patterns(marked.withColumn("seed", full), confidence, support)
        vouched = names.select("doc_id", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi").select("doc_id", "start", "end").distinct().withColumn("ok", F.lit(True))
        if k == rounds - 1:
            vouched = cut(vouched)
        j = names.join(vouched, ["doc_id", "start", "end"], "left")
        parts = j.select("doc_id", F.coalesce("ok", F.lit(False)).alias("ok"), F.inline(F.array(F.struct(F.col("given").alias("token"), F.lit("given").alias("role")), F.struct(F.col("family").alias("token"), F.lit("family").alias("role"))))).where("token is not null")
        by_doc = parts.groupBy("token", "role", "doc_id").agg(F.max("ok").alias("ok"))
        votes = by_doc.groupBy("token", "role").agg(F.sum(F.col("ok").cast("int")).alias("good"), F.count("*").alias("docs"))
        fit = votes.where((F.col("good") >= 1) & (F.col("good") >= share * F.col("docs")))
        if k == rounds - 1:
            fit = cut(fit)
        known = cut(known.unionByName(fit.where(F.col("good") >= least_docs).select("token", "role")).distinct())
    single = fit.where(F.col("good") < least_docs).join(known, ["token", "role"], "left_anti").select("token", "role", F.lit(True).alias("new"))
    usable = known.withColumn("new", F.lit(False)).unionByName(single)
    part = lambda r: usable.where(F.col("role") == r).select(F.col("token").alias(r), F.col("new").alias(f"new_{r}"))
    direct = names.drop("patterns").join(vouched, ["doc_id", "start", "end"], "left_semi").join(part("family"), "family").join(part("given"), "given", "left")
    whole = F.col("given").isNull() | F.col("new_given").isNotNull()
    return known, direct.where(whole & (F.col("new_family") | F.coalesce("new_given", F.lit(False)))).select("doc_id", "start", "end", "surface")


def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of overlapping spans those that don't overlap and cover most together, so that a list of names isn't read across its commas."""
    out: list[tuple[int, int]] = []
    cluster: list[tuple[int, int]] = []
    for span in [*sorted(set(spans)), None]:
        if cluster and (span is None or span[0] >= max(e for _, e in cluster[-8:])):
            out += _most_covering(cluster)
            cluster = []
        if span is not None:
            cluster.append(span)
    return out


def _most_covering(cluster: list[tuple[int, int]]) -> list[tuple[int, int]]:
    cluster = sorted(cluster, key=lambda x: (x[1], x[0]))
    best, link = [0], [(0, False)]  # the most that the first k spans cover, and how
    for k, (s, e) in enumerate(cluster):
        before = k
        while before and cluster[before - 1][1] > s:
            before -= 1
        take = best[before] + e - s > best[k]
        best.append(best[before] + e - s if take else best[k])
        link.append((before if take else k, take))
    out, k = [], len(cluster)
    while k:
        back, take = link[k]
        if take:
            out.append(cluster[k - 1])
        k = back
    return out[::-1]


def _names(words: dict[str, set[str]] | None):
    """Names whose parts are all known, in any case; words None means that each row brings its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families = None if words is None else _automaton(w for w, roles in words.items() if "family" in roles)
        for b in batches:
            rows = []
            own = b["known"].to_pylist() if words is None else [None] * b.num_rows
            for i, text, mine in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), own, strict=True):
                if words is None:
                    known: dict[str, set[str]] = {}
                    for k in mine or []:
                        known.setdefault(k["token"], set()).add(k["role"])
                else:
                    known = words
                    if not holds_word(families, fold(text)):
                        continue
                got, taken = [], None
                for s, e, given, family, _ in name_spans(text, lambda w: w.lower() in known or fold(w) in known):  # noqa: B023
                    if "family" in known.get(fold(family), ()) and (given is None or "given" in known.get(fold(given), ())):
                        taken = list(emails(text)) if taken is None else taken
                        if all(e <= x or s >= y for x, y in taken):
                            got.append((s, e))
                rows += [(i, "name", s, e, text[s:e]) for s, e in apart(got)]
            names = ["doc_id", "kind", "start", "end", "surface"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()], strict=True)], names=names)

    return run


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each text, as names are looked up by them."""
    for b in batches:
        for part in range(0, b.num_rows, 1000):
            p, ids, words = b.slice(part, 1000), [], []
            for i, text in zip(p["doc_id"].to_pylist(), p["text"].to_pylist(), strict=True):
                own = {fold(w) for w in WORD.findall(text)}
                ids += [i] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], names=["doc_id", "token"])


def found_names(texts: DataFrame, known: DataFrame, most: int = 200_000) -> DataFrame:
    """(doc_id, kind, start, end, surface) of the names in texts; known goes to the workers up to ``most`` rows, beyond that each document gets its own part of it by a join."""
    schema = "doc_id long, kind string, start int, end int, surface string"
    rows = known.limit(most + 1).collect() if known.count() <= most else None
    if rows is not None:
        words: dict[str, set[str]] = {}
        for r in rows:
            words.setdefault(r["token"], set()).add(r["role"])
        return texts.mapInArrow(_names(words), schema)
    own = texts.select("doc_id", "text").mapInArrow(_words, "doc_id long, token string").join(known, "token").groupBy("doc_id").agg(F.collect_set(F.struct("token", "role")).alias("known"))
    return texts.join(own, "doc_id").select("doc_id", "text", "known").mapInArrow(_names(None), schema)


def _free_of_own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, spans in zip(b["doc_id"].to_pylist(), b["spans"].to_pylist(), strict=True):
            own = apart([(x["start"], x["end"]) for x in spans if not x["new"]])
            surfaces = {(x["start"], x["end"]): x["surface"] for x in spans if x["new"]}
            starts = [s for s, _ in own]
            for s, e in surfaces:
                k = bisect_left(starts, e)  # the last own name that begins before the end
                if k and own[k - 1][1] > s:
                    surfaces[s, e] = None
            rows += [(i, "name", s, e, surfaces[s, e]) for s, e in apart([x for x, t in surfaces.items() if t is not None])]
        names = ["doc_id", "kind", "start", "end", "surface"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()], strict=True)], names=names)


def with_vouched(names: DataFrame, vouched: DataFrame) -> DataFrame:
    """names (doc_id, kind, start, end, surface) and those of vouched (doc_id, start, end, surface) that overlap none of them, nor each other."""
    both = names.select("doc_id", "start", "end", "surface", F.lit(False).alias("new")).unionByName(vouched.withColumn("new", F.lit(True)))
    by_doc = both.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "surface", "new")).alias("spans"), F.bool_or("new").alias("any")).where("any")
    return names.unionByName(by_doc.select("doc_id", "spans").mapInArrow(_free_of_own, "doc_id long, kind string, start int, end int, surface string"))


def mentions(documents: DataFrame, name_lexicon: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, surface) of every mention, start and end counting characters from 0.

    Null and empty texts have none. doc_id must be unique; other columns don't matter.
    """
    spark = documents.sparkSession
    texts = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    lexicon = seed_lexicon(name_lexicon)
    found = cut(texts.mapInArrow(_find(lexicon), CANDIDATE))
    seeds = spark.createDataFrame([(k, v) for k, own in sorted(lexicon.items()) for v in sorted(own)], "token string, role string")
    known, vouched = learned_names(found, seeds)
    names = with_vouched(cut(found_names(texts, known)), vouched)
    return accepted_numbers(found).unionByName(names)


def distinct_mentions(documents: DataFrame, name_lexicon: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, pii_text): the different mentions of each document."""
    return mentions(documents, name_lexicon).select("doc_id", F.col("kind").alias("pii_kind"), F.col("surface").alias("pii_text")).distinct()


def _replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
            if text is not None and spans:
                at, parts = 0, []
                for s in sorted(spans, key=lambda x: (x["start"], -x["end"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], PLACEHOLDERS[s["kind"]]]
                        at = s["end"]
                text = "".join([*parts, text[at:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.string())], names=["doc_id", "text"])


def redacted(documents: DataFrame, name_lexicon: DataFrame) -> DataFrame:
    """(doc_id, text) of every document, mentions replaced by typed placeholders; null texts stay null."""
    spans = mentions(documents, name_lexicon).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "start", "end")).alias("spans"))
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_replace, "doc_id long, text string")
