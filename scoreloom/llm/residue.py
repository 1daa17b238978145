"""Texts that hold placeholders, filler, error messages or script notices instead of content."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scoreloom.llm.languages import COMMON, VOTES
from scoreloom.llm.phrases import automaton, bare, coverage, whole_word
from scoreloom.session import spread

#: Phrases that say what a text is wherever they stand in it.
ERROR = """
internal server error|bad gateway|service unavailable|gateway timeout|too many requests|upstream request failed
request timeout|something went wrong|an unexpected error occurred|cuda out of memory|out of memory error
traceback (most recent call last)|connection refused|connection reset by peer|connectionerror:|timeouterror:
rate limit exceeded|quota exceeded|resource_exhausted|model is overloaded|hết hạn mức gọi mô hình
đã xảy ra lỗi hệ thống|đã xảy ra lỗi, vui lòng|lỗi máy chủ nội bộ|không thể tạo phản hồi|mất kết nối tới
trang bạn yêu cầu không tồn tại|không tìm thấy trang|máy chủ quá tải|hệ thống đang bảo trì|phiên làm việc đã hết hạn
ha ocurrido un error|error interno del servidor|une erreur s'est produite|ein fehler ist aufgetreten|terjadi kesalahan
произошла ошибка|服务器错误|内部错误|サーバーエラー|エラーが発生しました|오류가 발생했습니다|เกิดข้อผิดพลาด
""".replace("\n", "|").strip("|").split("|")
SCRIPT = """
enable javascript|requires javascript|javascript is disabled|javascript is required|javascript to run this app
without javascript|turn on javascript|activate javascript|turn on scripts|enable scripts|please enable cookies
bật javascript|kích hoạt javascript|cần javascript|không có javascript|yêu cầu javascript|tắt javascript
yêu cầu bật script|bật script|đã tắt tập lệnh|bật tập lệnh|kích hoạt tập lệnh|<noscript>
activer javascript|habilite javascript|habilitar javascript|active javascript|javascript aktivieren|aktifkan javascript
включите javascript|启用javascript|启用 javascript|javascriptを有効|자바스크립트|checking your browser before accessing
đang kiểm tra trình duyệt của bạn
""".replace("\n", "|").strip("|").split("|")
FILLER = """
lorem ipsum|placeholder text|sample answer text|sample text goes here|your response goes here|your answer goes here
your text goes here|insert text here|text goes here|content goes here|answer goes here|to be completed|coming soon
văn bản giữ chỗ|văn bản mẫu, nội dung|nội dung đang được biên soạn|nội dung sẽ được cập nhật|đang cập nhật nội dung
phần này để trống|chưa có nội dung|điền sau|viết lời giải ở đây|viết câu trả lời ở đây|nhập nội dung|nội dung mẫu
texto de ejemplo|texto de relleno|texte de remplissage|platzhaltertext|teks contoh|此处填写|在此输入|待补充
""".replace("\n", "|").strip("|").split("|")
#: Phrases that count only where such phrases make up at least WEAK_SHARE of a text.
WEAK = """
not found|forbidden|unauthorized|bad request|timeout|quá tải|vui lòng thử lại sau|please try again later|try again
mã tham chiếu|không phản hồi|trả về mã|error|lỗi|reload|tải lại trang|trình duyệt|browser|javascript|cookie|test|todo|tbd
""".replace("\n", "|").strip("|").split("|")
WEAK_SHARE = 0.35

#: Names that templates give to what is to be filled in; names with an underscore count as well.
NAMES = frozenset("answer question solution response name value text content result prompt input output title date user topic reason explanation".split())
#: What instructions to fill something in begin with, within <> or [], and end with, within <>.
FILL_IN_ANY, FILL_IN_SQUARE, FILL_IN_ENDS = ("insert",), (
    "your", "điền", "dien", "nhập", "nhap", "chèn", "thêm", "giải thích", "giai thich", "mô tả", "mo ta", "viết", "lý do", "tên", "nêu",
), ("ở đây", "o day", "vào đây", "here")
#: Opening marks of placeholders with their closing marks.
MARKS = {"{{": "}}", "{%": "%}", "${": "}", "#{": "}", "%(": ")", "[[": "]]", "<<": ">>", "@@": "@@", "__": "__", "{": "}", "<": ">", "[": "]"}
#: Names of HTTP failures, which count after their number, and what stands before a number of a failure.
STATUS_NAMES = ("not found", "forbidden", "unauthorized", "bad request", "request timeout", "conflict", "gone", "payment required")
STATUS_LEADS = ("http", "status=", "status =", "status:", "status :", "[error:", '"error"', "error:")

#: A public passage of pseudo-Latin filler; the character model of filler words is made of it.
PASSAGE = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad
minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in
voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia
deserunt mollit anim id est laborum sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium
totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo nemo enim ipsam
voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt
neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit sed quia non numquam eius modi tempora incidunt
ut labore et dolore magnam aliquam quaerat voluptatem ut enim ad minima veniam quis nostrum exercitationem ullam corporis suscipit
laboriosam nisi ut aliquid ex ea commodi consequatur
"""
#: Words that stand for nothing, and the rows of a keyboard.
IDLE = frozenset("foo bar baz qux blah test".split())
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
#: Filler words in a row that make a case anywhere, and where there is hardly anything else.
LONG_RUN, SHORT_RUN = 5, 3
#: Mean score of a run of words, in nats, from which it is pseudo-Latin rather than words of a language.
LATIN_SCORE = 0.75

_WORD = re.compile(r"[^\W\d_]+")
_IDENT = re.compile(r"[A-Za-z_]\w*")
_LOWER = re.compile(r"[a-z]\w*_\w+")
_UPPER = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+")
_CODE = re.compile(r"[^\n]{0,80}?\b[45]\d\d\b")
_RUN = re.compile(r"(?:\b[a-z]{3,}\b[^\w\n]*){4}\b[a-z]{3,}\b")
_PATTERNS = None


def _patterns() -> ahocorasick.Automaton:
    """One automaton of all patterns; a match gives its type and length."""
    a = automaton({"error": ERROR, "script": SCRIPT, "filler": FILLER, "weak": WEAK}, make=False)
    for kind, patterns in (("mark", MARKS), ("status", STATUS_NAMES), ("lead", STATUS_LEADS)):
        for p in patterns:
            old = a.get(p, ())
            a.add_word(p, (*old, (kind, len(p))))
    a.make_automaton()
    return a


def _placeholder(text: str, at: int, mark: str) -> int:
    """Where the placeholder that begins with a mark ends, or 0 if none does.

    It ends with the closing mark of the same line; `{x}`, `<x>` and `[x]` also
    need a name or an instruction inside, as formulas, sets and remarks have them
    too.
    """
    start = at + len(mark)
    close = MARKS[mark]
    end = text.find(close, start)
    if end <= start or text.find("\n", start, end) >= 0:
        return 0
    inside, after = text[start:end], end + len(close)
    if mark in ("{{", "{%", "${", "#{"):
        return after if "{" not in inside and "}" not in inside else 0
    if mark in ("%(", "[[", "<<", "@@"):
        return after if _IDENT.fullmatch(inside) and (mark != "%(" or text[after : after + 1] in ("s", "d", "r", "f")) else 0
    before, behind = text[at - 1 : at] if at else "", text[after : after + 1]
    if mark == "__":
        named = inside[:1].isalpha() and inside.isupper() and _IDENT.fullmatch(inside)
        return after if named and not (before == "_" or before.isalnum() or behind == "_" or behind.isalnum()) else 0
    if mark == "{":
        return after if (_LOWER.fullmatch(inside) or inside in NAMES) and not (before.isalnum() or before and before in "\\_^}{") else 0
    if _UPPER.fullmatch(inside) or inside.isupper() and inside.lower() in NAMES:
        return after
    low = inside.lower()
    begins = lambda words: any(low.startswith(w) and not low[len(w) : len(w) + 1].isalnum() for w in words)
    if mark == "<":
        return after if _LOWER.fullmatch(inside) or inside in NAMES or "<" not in inside and (begins(FILL_IN_ANY) or low.endswith(FILL_IN_ENDS)) else 0
    return after if "[" not in inside and (begins(FILL_IN_ANY) or begins(FILL_IN_SQUARE)) else 0


def _status(low: str, start: int, end: int, kind: str) -> int:
    """Where the name of a failure with its number ends, or 0 if there is no number."""
    if kind == "status":
        head = low[max(0, start - 8) : start].rstrip(" \t-–—:")
        code = head[-3:]
        return end if len(code) == 3 and code.isdigit() and code[0] in "45" and not head[-4:-3].isalnum() else 0
    lead = low[start:end]
    if lead == '"error"':
        return end if low[end:].lstrip()[:1] == ":" and low[end:].lstrip()[1:].lstrip()[:1] in ("{", '"') else 0
    if lead == "[error:":
        return end
    if lead == "error:":
        line = low[low.rfind("\n", 0, start) + 1 : start]
        m = len(line) <= 3 and not any(c.isalnum() for c in line) and low[end : end + 1].isspace() and _CODE.match(low, end)
        return m.end() if m else 0
    rest = low[end : end + 12]
    if lead == "http":
        rest = re.sub(r"^/\d(?:\.\d)?", "", rest)
        if not rest[:1].isspace():
            return 0
    if start and low[start - 1].isalnum():
        return 0
    rest = rest.lstrip()
    return end if rest[:1] in ("4", "5") and rest[:3].isdigit() and len(rest[:3]) == 3 and not rest[3:4].isalnum() else 0


def kind_of(text: str | None) -> tuple[str, float] | None:
    """Kind of residue and the share of the text under matches, or None.

    Kinds are placeholder, filler, error and script. One automaton finds the
    phrases, the opening marks of placeholders and the names of failures; marks and
    names are read on from where they stand. A placeholder, a phrase of ERROR,
    SCRIPT or FILLER, a failure with its number, or five words of nonsense in a row
    make a case wherever they stand; weak phrases only by their coverage.
    """
    global _PATTERNS
    if not text:
        return None
    if _PATTERNS is None:
        _PATTERNS = _patterns()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[0] for c in text)
    found: dict[str, list[tuple[int, int]]] = {}
    for last, kinds in _PATTERNS.iter(low):
        for kind, n in kinds:
            start, end = last + 1 - n, last + 1
            if kind == "mark":
                if after := _placeholder(text, start, low[start:end]):
                    found.setdefault("placeholder", []).append((start, after))
            elif kind in ("status", "lead"):
                if (kind == "lead" or whole_word(low, start, end)) and (after := _status(low, start, end, kind)):
                    found.setdefault("status", []).append((start, after))
            elif whole_word(low, start, end):
                found.setdefault(kind, []).append((start, end))
    for kind in ("placeholder", "script", "error", "filler", "status"):
        if kind in found:
            return "error" if kind == "status" else kind, coverage([s for v in found.values() for s in v]) / len(text)
    if (share := _nonsense(low)) > 0:
        return "filler", share
    weak = found.get("weak")
    if weak:
        share = coverage(weak) / max(1, len(text.strip()))
        if share >= WEAK_SHARE and len(low.split()) > 1:
            return "error", share
    return None


@lru_cache(1)
def _model() -> dict[str, float]:
    """For pairs of letters, how much likelier pseudo-Latin has them than common words of languages, in nats."""
    pairs = lambda words: Counter(p for w in words for p in zip("^" + w, w + "$"))
    latin, other = pairs(set(PASSAGE.split())), pairs({bare(w) for words in COMMON.values() for w in words.split()})
    letters = [*map(chr, range(97, 123)), "^", "$"]
    add = 0.3
    n, m = sum(latin.values()) + add * 27 * 27, sum(other.values()) + add * 27 * 27
    return {(x, y): math.log((latin[x, y] + add) / n) - math.log((other[x, y] + add) / m) for x in letters for y in letters}


@lru_cache(50_000)
def latin_score(word: str) -> float | None:
    """Log-likelihood of a word of three letters or more as pseudo-Latin; None for a common word of a language or with other letters."""
    if len(word) < 3 or not word.isascii() or word in VOTES:
        return None
    model = _model()
    return sum(model[p] for p in zip("^" + word, word + "$"))


@lru_cache(50_000)
def is_idle(word: str) -> bool:
    """Whether a word stands for nothing: one of IDLE, a letter repeated, or neighbouring keys or letters in a row."""
    return word in IDLE or len(word) >= 3 and (len(set(word)) == 1 or any(word in row for row in ROWS))


def _nonsense(low: str) -> float:
    """Share of the text in runs of nonsense words; 0 if there is none."""
    words = _WORD.findall(low)
    longest = size = 0
    if any(map(is_idle, words)):
        run = 0
        for w in words:
            run = run + 1 if is_idle(w) else 0
            size += len(w) + 1 if run else 0
            longest = max(longest, run)
    latin = 0
    if _RUN.search(low):
        run, total, chars = 0, 0.0, 0
        for w in (*words, ""):
            if (s := latin_score(w)) is not None:
                run, total, chars = run + 1, total + s, chars + len(w) + 1
                continue
            if run >= LONG_RUN and total >= LATIN_SCORE * run:
                latin += chars
            run, total, chars = 0, 0.0, 0
    only = longest >= SHORT_RUN and size >= 0.9 * len(low.strip())
    return min(1.0, (latin + (size if longest >= LONG_RUN or only else 0)) / len(low))


def residue(df: DataFrame, id_col: str, text_cols: list[str], out_id: str = "result_id") -> DataFrame:
    """One row for each text of `text_cols` that is residue: id, text_field, kind, share.

    One pass over whole texts; a table of fewer parts than cores is spread first. Null, empty and blank texts are
    no residue; repeated rows come out each; an empty table gives no row.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, field, kind, share = [], [], [], []
            for k, name in enumerate(text_cols, 1):
                for i, text in enumerate(batch.column(k).to_pylist()):
                    if text and (r := kind_of(text)):
                        at.append(i)
                        field.append(name)
                        kind.append(r[0])
                        share.append(r[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(kind, pa.string()), pa.array(share, pa.float64())],
                [out_id, "text_field", "kind", "share"],
            )

    schema = T.StructType(
        [
            T.StructField(out_id, df.schema[id_col].dataType),
            T.StructField("text_field", T.StringType()),
            T.StructField("kind", T.StringType()),
            T.StructField("share", T.DoubleType()),
        ]
    )
    return spread(df.select(f"`{id_col}`", *(f"`{c}`" for c in text_cols))).mapInArrow(run, schema)
