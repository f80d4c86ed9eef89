"""Sentence boundaries by cascading tables of break and no-break rules.

A text is cut into blocks (paragraphs, headings, list items; fenced code is left out). Within a
block every run of end marks with its closing quotes or brackets is a candidate, and so is every
blank between Thai letters. The rules of the block's language are tried in order, then those of
its script, then the defaults; the first whose two patterns match what lies before and after the
candidate decides. Code spans, links and balanced quotations and brackets are masked first, so
marks inside them end nothing unless the quotation itself ends the sentence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spandrel.llm.arrow_rows import small_batches

MARKS = ".!?…。！？।؟"
_OPEN = "“‘„‚«‹「『（(［[｛{〈《【〔"
_CLOSE = "”’“»›」』）)］]｝}〉》】〕\"'"
_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "［": "］", "[": "]", "《": "》", "〈": "〉", "【": "】"}

_CAND = regex.compile(rf"[{MARKS}]+(?:[ \u00a0\u202f]?[»›]|[{regex.escape(_CLOSE)}])*|(?<=[\p{{Thai}}])[^\S\r\n]+(?=[\p{{Thai}}])")
_CODE = regex.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)|\bhttps?://\S+|\bwww\.\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+", regex.S)
_QUOTES = regex.compile(r"[“”„‟«»‹›「」『』（）()［］\[\]《》〈〉【】\"‘’]")
_LINE = regex.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")
_FENCE = regex.compile(r"[ \t]{0,3}(?:> ?)*(`{3,}|~{3,})")
_HEAD = regex.compile(r"[ \t]{0,3}#{1,6}(?=[ \t]|$|[\r\n])")
_ITEM = regex.compile(r"[ \t]*(?:[-*+]|(\d{1,9})[.)])(?=[ \t])")
_QUOTE = regex.compile(r"[ \t]{0,3}>")
_RULE = regex.compile(r"[ \t]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|=+[ \t]*)[\r\n]*$")
_MARKER = regex.compile(r"(?:\s|>|#{1,6}(?=\s|$)|[-*+](?=\s)|\d{1,9}[.)](?=\s))*")
_TAIL = regex.compile(r"[ \t]+#+[ \t]*$")

_COMPANY = r"\b(?:Inc|Ltd|Corp|Co|Bros|LLC|Cie|Ges)\."
_STARTER = r"\s+(?:The|This|That|These|Those|It|Its|He|She|We|They|You|In|On|At|A|An|But|And|So|If|When|After|Before|There|Each|Every|Our|One|No|Why|Is|Who|Der|Die|Das|Ein|Eine|Es|Er|Sie|Wir|Am|Im|Wer|Nach|Warum|Le|La|Les|Un|Une|Il|Elle|El|Los|Las|Una)\b"
_NUMBERED = r"\s*(?:[#№]\s*)?[\d(]"


def _rx(before: str, after: str, is_break: bool) -> tuple:
    return before, after, is_break


#: Per language: (before, after, break?), in order. Word lists are fixed values.
TABLES: dict[str, list[tuple]] = {
    "en": [
        _rx(r"\b(?:Dr|Prof|Mr|Mrs|Ms|Mx|Messrs|Rev|Hon|Gen|Col|Capt|Lt|Sgt|Gov|Sen|Rep|St|Mt)\.", r"\s", False),
        _rx(_COMPANY, _STARTER, True),
        _rx(_COMPANY, r"\s", False),
        _rx(r"\b(?:e\.\s?g|i\.\s?e|[Cc]f|vs|viz|[Aa]pprox|resp|esp|incl|excl|ca|al)\.", r"\s", False),
        _rx(r"\b(?:No|Nos|no|nos|Fig|Figs|fig|figs|Sec|sec|Ch|ch|Eq|eq|Vol|vol|Art|art|pp|p|Tab|tab|App|Ref|ref|Ex|ex|Pt|pt)\.", _NUMBERED, False),
        _rx(r"\b(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.", r"\s*\d", False),
        _rx(r"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\.", r"\s*,", False),
    ],
    "de": [
        _rx(r"\b(?:z\.\s?B|d\.\s?h|u\.\s?a|o\.\s?ä|i\.\s?d\.\s?R|s\.\s?o|s\.\s?u|v\.\s?a|z\.\s?T|u\.\s?U)\.", r"\s", False),
        _rx(r"(?<![\w.])(?:z|d|u|i|o|s|v|m)\.", r"\s?\p{Lu}", False),
        _rx(r"\b(?:[Vv]gl|bzw|[Cc]a|Nr|Nrn|Abs|Art|Abb|Bd|Hr|Fr|Dipl|Ing|inkl|exkl|gem|evtl|ggf|sog|Tel|Str|S|Kap|zzgl|bspw|max|min|rd|Mio|Mrd)\.", r"\s", False),
        _rx(r"(?i:\b(?:am|im|vom|zum|bis|den|der|die|das|dem|des|jede[rsnm]?|seit|ab|beim|stand:|und|oder|ein|eine|einer)\s+\d{1,4}\.)", r"\s", False),
        _rx(r"\b\d{1,2}\.", r"\s*(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|\d{1,2}\.)", False),
    ],
    "fr": [
        _rx(r"\b(?:M|MM|Mme|Mlle|Mgr|Me|Dr|Pr|Vve)\.", r"\s", False),
        _rx(r"\b(?:p\.\s?ex|c\.-à-d|[Ee]nv|[Cc]f|[Cc]hap|fig|art|vol|éd|t|av|apr|n|N)\.", r"\s", False),
    ],
    "es": [
        _rx(r"\b(?:Sr|Sra|Sres|Srta|Dr|Dra|Prof|Profa|Ing|Lic|Ud|Uds|Vd|D|Dña|Sto|Sta)\.", r"\s", False),
        _rx(r"\b(?:p\.\s?ej|[Aa]prox|[Pp]ág|págs|núm|art|cap|fig|vol|EE|tel)\.", r"\s", False),
    ],
    "ru": [
        _rx(r"\d\s?г\.", r"\s+\p{Lu}", True),
        _rx(r"\bт\.", r"\s?(?:д|п|е|к|н|о)\.", False),
        _rx(r"\b(?:т\.\s?(?:е|к|н|о)|г|гг|[Рр]ис|[Тт]абл|[Сс]м|стр|ул|им|проф|акад|доц|гл|ст|напр|тыс|млн|млрд|руб|д-р|св|о|р|ср|Ср|п|пп)\.", r"\s", False),
    ],
    "zh": [
        _rx(r"[：:]\s*[“「『《][^”」』》]*[。！？…!?]+[”」』》]", r"", True),
        _rx(r"[。！？…!?]+[”’」』》]", r"\s*(?:[“「『《]|$)", True),
        _rx(r"[。！？…!?]+[”’」』》]", r"[^\s]", False),
        _rx(r"[）)】]", r"[^\s]", False),
    ],
    "ja": [
        _rx(r"[。！？…!?]+[」』”）)]", r"\s*(?:と|って|という|との|の|を|は|が|に|で|も|な|や|か|、|，|だ|です|から|まで|より)", False),
        _rx(r"[）)】]", r"[^\s]", False),
    ],
    "hi": [
        _rx(r"(?:डॉ|श्री|सुश्री|प्रो|पं|रु)\.", r"\s", False),
    ],
    "ar": [
        _rx(r"(?:د|أ|م|ص|ج|هـ)\.", r"\s", False),
    ],
    "th": [
        _rx(r"(?:พ\.ศ|ค\.ศ|ดร|น|ม\.ค|ก\.พ)\.", r"\s", False),
    ],
}
#: Tried after the language's own table: what holds for a script, then for all.
LATIN = [
    _rx(r"(?:^|[\s(\[“„«‘\"'-])\p{Lu}\.", r"\s+\p{Lu}", False),  # initials
    _rx(r"\.", r"\s+\p{Ll}", False),
    _rx(r"…", r"\s*\p{Ll}", False),
    _rx(r"[.!?…][^\p{L}\p{N}]+", r"\s+\p{Ll}", False),  # the sentence goes on after a quotation
    _rx(r"[.…]", r"\s*[,;:—–)\]]", False),
    _rx(r"[!?][^\s]*", r"\s*[,;]", False),
]
CJK = [
    _rx(r"…", r"\s*[^\s“「『]", False),
    _rx(r"\.{2,}", r"\s*[^\s]", False),
    _rx(r"[。！？!?][^\p{L}\p{N}]*", r"[^,，、；;：:]", True),
    _rx(r"[。！？!?][^\p{L}\p{N}]*", r"[,，、；;：:]", False),
]
DEFAULT = [
    _rx(r"[.!?…।؟][^\p{L}\p{N}]*", r"\s", True),
    _rx(r"[.!?…]+[^\p{L}\p{N}]*", r"$", True),
    _rx(r"[।؟。！？][^\p{L}\p{N}]*", r"[\p{L}\p{N}]", True),
    _rx(r"[!?]+", r"[\p{Han}\p{Hiragana}\p{Katakana}]", True),
]
_LATIN_LANGS = ("en", "de", "fr", "es")
_WORDS = {
    "de": regex.compile(r"\b(?:der|die|das|und|ist|nicht|den|ein|eine|von|zu|für|mit|auf|im|am|wie)\b"),
    "fr": regex.compile(r"\b(?:le|la|les|et|est|une|des|du|dans|pour|sur|pas|que|sa|se|qui)\b"),
    "es": regex.compile(r"\b(?:el|la|los|las|y|es|una|del|en|para|por|no|que|se|con|hay|sigue)\b"),
    "en": regex.compile(r"\b(?:the|and|is|of|to|in|a|for|on|was|it|that|with|no|so|by|or)\b"),
}
_SCRIPTS = [("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("zh", regex.compile(r"\p{Han}")), ("th", regex.compile(r"\p{Thai}")),
            ("hi", regex.compile(r"\p{Devanagari}")), ("ar", regex.compile(r"\p{Arabic}")), ("ru", regex.compile(r"\p{Cyrillic}"))]


def language_of(block: str) -> str:
    """The language whose table comes first, by script and, for Latin, by common words."""
    if not block.isascii():
        for lang, rx in _SCRIPTS:
            if rx.search(block):
                return lang
    low = block.lower()
    return max(_LATIN_LANGS, key=lambda x: len(_WORDS[x].findall(low)))


def _cascade(lang: str) -> list[tuple]:
    if lang in ("zh", "ja"):
        return TABLES[lang] + CJK + [r for x in _LATIN_LANGS for r in TABLES[x]] + LATIN + DEFAULT
    own = [lang, *(x for x in (*_LATIN_LANGS, "ru") if x != lang)]
    return [r for x in own for r in TABLES[x]] + LATIN + DEFAULT


def _compiled(lang: str) -> tuple[regex.Pattern, list[bool]]:
    """A cascade as one pattern whose alternatives are its rules in order; the number of the group
    that matched is the number of the rule."""
    rules = _cascade(lang)
    return regex.compile("|".join(f"(?<={b})(?={a})()" for b, a, _ in rules)), [k for _, _, k in rules]


_CASCADES = {x: _compiled(x) for x in TABLES}


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of the text's blocks, markers included, fenced code left out."""
    out: list[tuple[int, int]] = []
    start, ordinal, fence, quoted = -1, None, "", False
    at, n = 0, len(text)

    def close(end: int) -> None:
        nonlocal start
        if start >= 0:
            out.append((start, end))
        start = -1

    while at < n:
        m = _LINE.match(text, at)
        line, end = m.group(), m.end()
        if fence:
            if (f := _FENCE.match(line)) and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not line[f.end():].strip():
                fence = ""
        elif not line.strip():
            close(at)
            ordinal, quoted = None, False
        elif f := _FENCE.match(line):
            close(at)
            fence, ordinal = f[1], None
        elif _HEAD.match(line):
            close(at)
            out.append((at, end))
            ordinal = None
        elif _RULE.match(line):
            close(at)
            ordinal = None
        elif (i := _ITEM.match(line)) and (start < 0 or i[1] is None or int(i[1]) == 1 or (ordinal is not None and int(i[1]) == ordinal + 1)):
            close(at)
            start, ordinal = at, int(i[1]) if i[1] else None
        elif start < 0:
            start, quoted = at, bool(_QUOTE.match(line))
        elif _QUOTE.match(line) and not quoted:
            close(at)
            start, quoted = at, True
        at = end
    close(n)
    return out


def _inside(s: str) -> tuple[bytearray, dict[int, int]]:
    """1 at every place inside a balanced quotation or bracket (its closer not counted), and the
    opener of every closing bracket."""
    depth = bytearray(len(s))
    stack: list[tuple[str, int]] = []
    spans = []
    for m in _QUOTES.finditer(s):
        i, c = m.start(), m.group()
        if c in _PAIRS and not (c == "“" and stack and c in stack[-1][0]):
            stack.append((_PAIRS[c], i))
        elif stack and c in stack[-1][0]:
            spans.append((stack.pop()[1], i))
        elif c == '"':
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), -1)
            if k >= 0:
                spans.append((stack[k][1], i))
                del stack[k:]
            else:
                stack.append(('"', i))
        elif c in "”»」』）)］]":
            k = next((k for k in range(len(stack) - 1, -1, -1) if c in stack[k][0]), -1)
            if k >= 0:
                spans.append((stack[k][1], i))
                del stack[k:]
    for a, b in spans:
        depth[a:b] = b"\x01" * (b - a)
    return depth, {b: a for a, b in spans if s[b] in ")）]］】"}


def block_sentences(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    a = _MARKER.match(text, a, b).end()
    s = text[a:b].rstrip()
    if not s:
        return
    if _TAIL.search(s) and _HEAD.match(text, text.rfind("\n", 0, a) + 1):
        s = s[: _TAIL.search(s).start()]
    masked = _CODE.sub(lambda m: _mask(m), s) if "`" in s or "://" in s or "@" in s or "www." in s else s
    inside, openers = _inside(masked) if _QUOTES.search(masked) else (None, {})
    rules = None
    start = 0
    for m in _CAND.finditer(masked):
        p = m.end()
        if p >= len(masked):
            break
        if m.group().isspace():
            if not (inside and inside[m.start()]):
                yield from _span(s, start, m.start(), a)
                start = p
            continue
        if inside and p > 0 and inside[p - 1] and inside[p]:
            continue
        if openers and any(openers.get(i, -1) > start and masked[start : openers[i]].strip() for i in range(m.start(), p)):
            continue  # the mark belongs to a bracket within a larger sentence
        if rules is None:
            rules = _CASCADES[language_of(masked)]
        decided = rules[0].match(masked, p)
        if decided and rules[1][decided.lastindex - 1]:
            yield from _span(s, start, p, a)
            start = p
    yield from _span(s, start, len(s), a)


def _mask(m: regex.Match) -> str:
    """A code span or link as one word; end marks after a link's last letter stay."""
    g = m.group()
    if g[0] == "`":
        return "`" + "x" * (len(g) - 2) + "`"
    keep = len(g) - len(g.rstrip(MARKS + _CLOSE + ",;:"))
    return "x" * (len(g) - keep) + g[len(g) - keep :]


def _span(s: str, i: int, j: int, offset: int) -> Iterator[tuple[int, int]]:
    while i < j and (s[i].isspace() or (s[i] == ">" and (i == 0 or s[i - 1] in "\r\n"))):
        i += 1
    while j > i and s[j - 1].isspace():
        j -= 1
    if i < j:
        yield offset + i, offset + j


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Code point offsets (start, end) of a text's sentences, end exclusive."""
    if not text:
        return []
    return [x for a, b in blocks(text) for x in block_sentences(text, a, b)]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        rows, spans = [], []
        for row, t in enumerate(b.column(1).to_pylist()):
            found = sentences(t)
            rows += [row] * len(found)
            spans += found
        if rows:
            se = np.array(spans, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(se[:, 0]), pa.array(se[:, 1])], ["id", "start_pos", "end_pos"])


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_pos, end_pos) of every sentence of every row; null, empty and blank texts have
    none. A map over Arrow batches: no shuffle, and a long text costs time in proportion."""
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    return picked.mapInArrow(_run, f"id {kind}, start_pos bigint, end_pos bigint").withColumnRenamed("id", id_col)
