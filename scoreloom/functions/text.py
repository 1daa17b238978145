"""Text functions as Column expressions; they stay inside the JVM's generated code."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.numbers import let

#: ASCII punctuation, and Vietnamese words that carry no content.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STOP_WORDS = (
    "và hoặc của là có trong cho được với các những một này đó không đến từ về mà tôi bạn họ chúng nó lại rồi đã "
    "thì sẽ còn nên cần phải trên dưới theo nếu khi tại đây đấy bởi vì cũng"
).split()
SPACE = r"[ \t\n\r\f\x0B]"


def _accents() -> tuple[str, str]:
    """Letters with accents in the Vietnamese range and their base letters; đ stays."""
    source, target = [], []
    for i in [*range(0xC0, 0x180), 0x1A0, 0x1A1, 0x1AF, 0x1B0, *range(0x1EA0, 0x1EFA)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(i)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(i):
            source.append(chr(i))
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, BASE = _accents()
#: Letters that only Vietnamese and its neighbours write.
VIETNAMESE = "".join(c for c in (chr(i) for i in [*range(0xC0, 0x100), 0x102, 0x103, 0x110, 0x111, 0x128, 0x129, 0x168, 0x169, 0x1A0, 0x1A1, 0x1AF, 0x1B0, *range(0x1EA0, 0x1EFA)]) if c not in "ÄÅÆÇËÎÏÐÑÖ×ØÛÜÞßäåæçëîïðñö÷øûüþÿ")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def clean_text(c: Column, lower: bool = True, punctuation: bool = True, numbers: bool = False, spaces: bool = True, unicode: bool = False) -> Column:
    """Lower case, no ASCII punctuation, optionally no digits, single blanks; null is ''.

    With `unicode`, compatibility forms are folded first, which takes an Arrow pass.
    """
    out = F.coalesce(folded(c) if unicode else c, F.lit(""))
    if lower:
        out = F.lower(out)
    if punctuation:
        out = F.translate(out, PUNCTUATION, "")
    if numbers:
        out = F.regexp_replace(out, "[0-9]+", "")
    return collapse(out) if spaces else out


def folded(c: Column) -> Column:
    """A text in normal form NFKC."""
    from scoreloom.functions.udfs import nfkc

    return nfkc(c)


def remove_diacritics(c: Column) -> Column:
    """Base letters without accents, composed or not; đ isn't an accented d."""
    return F.translate(F.regexp_replace(c, "[\\u0300-\\u036F]", ""), ACCENTED, BASE)


def tokens(c: Column) -> Column:
    """Words and punctuation marks; an empty text has none."""
    spaced = collapse(F.regexp_replace(F.coalesce(c, F.lit("")), "([.,!?();:\"'])", " $1 "))
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def words(c: Column) -> Column:
    """Parts between blanks; an empty text has none."""
    return F.filter(F.split(collapse(F.coalesce(c, F.lit(""))), " "), lambda t: t != "")


def normalize_spacing(c: Column, unicode: bool = False) -> Column:
    """Blanks around punctuation, brackets and quotes as in print; with `unicode`, of the text in normal form NFKC."""
    c = folded(c) if unicode else c
    rules = (
        (SPACE + r"+([,.!?;:])", "$1"), (r"([,.!?;:])([^ \t\n\r\f\x0B0-9])", "$1 $2"), (r"\(" + SPACE + "+", "("), (SPACE + r"+\)", ")"),
        ('"' + SPACE + "+", '"'), (SPACE + '+"', '"'), ("'" + SPACE + "+", "'"), (SPACE + "+'", "'"),
    )
    out = F.coalesce(c, F.lit(""))
    for pattern, to in rules:
        out = F.regexp_replace(out, pattern, to)
    return collapse(out)


def numbers(c: Column) -> Column:
    """All numbers, with comma or point, as doubles."""
    found = F.regexp_extract_all(c, F.lit(r"[-+]?[0-9]+[.,]?[0-9]*"), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit(".")).try_cast("double")), lambda x: x.isNotNull())


def is_vietnamese(c: Column, threshold: float = 0.3) -> Column:
    """Whether the share of Vietnamese letters reaches the threshold; an empty text isn't."""
    own = F.char_length(c) - F.char_length(F.translate(c, VIETNAMESE, ""))
    return F.coalesce((F.char_length(c) > 0) & (own >= threshold * F.char_length(c)), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' different elements; 1 if both are empty."""
    share = lambda x, y: let(lambda u: F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / u), F.size(F.array_union(x, y)))
    return let(share, a, b)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 if both are empty."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def keywords(c: Column, stop: Sequence[str] = tuple(STOP_WORDS), least: int = 2) -> Column:
    """Tokens of the cleaned text that are no stop words and not too short."""
    return F.filter(tokens(clean_text(c)), lambda t: ~t.isin(*stop) & (F.char_length(t) >= least))


def format_number(c: Column, places: int = 2, comma: bool = True, currency: str | None = None) -> Column:
    """A number with points between thousands and a decimal comma, and its currency."""
    out = F.format_number(c, places)
    if comma:
        out = F.translate(out, ".,", ",.")
    return F.concat(out, F.lit(" đ" if currency.upper() == "VND" else f" {currency}")) if currency else out


def sentences(c: Column) -> Column:
    """Sentences of a text, split after a stop and white space, but not inside an abbreviation such as `p.m.`."""
    parts = F.split(normalize_spacing(c), r"(?<![0-9])(?<!\w\.\w\.)(?<=[.?!])\s+")
    return F.filter(F.transform(parts, F.trim), lambda s: s != "")


def ngrams(a: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by a blank."""
    at = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return let(lambda w: F.transform(at(w), lambda i: F.array_join(F.slice(w, i, n), " ")), a)


def preview(c: Column, n: int = 100) -> Column:
    """The first n characters, with dots if there are more."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


#: Final-answer markers of reasoned responses, in order.
ANSWER_MARKERS = ("final answer:", "therefore, the answer is", "thus, the answer is", "the answer is", "in conclusion,", "vậy kết quả là", "kết luận:")


def final_answer(c: Column) -> Column:
    """What follows the first marker that occurs, up to the paragraph's end; else the last paragraph."""
    found = [F.trim(F.regexp_extract(c, rf"(?isu){m}(.+?)(?:\z|\n\n)", 1)) for m in ANSWER_MARKERS]
    last = F.trim(F.element_at(F.split(c, "\n\n"), -1))
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found), F.nullif(last, F.lit("")), c)


def normalize_answer(c: Column) -> Column:
    """An answer for comparison: its first number, else its words in lower case."""
    plain = F.translate(F.lower(collapse(c)), ".,;:!?()\"'", "")
    return F.coalesce(F.nullif(F.regexp_extract(plain, r"[-+]?[0-9]*\.?[0-9]+", 0), F.lit("")), plain)


def difficulty(question: Column, solution: Column) -> Column:
    """Difficulty guessed from the lengths of question and solution in words."""
    level = lambda q, s: F.when(q == 0, "Dễ").when((s > 3.5 * q) | (s > 100), "Khó").when((s > 1.8 * q) | (s > 50), "Trung bình").otherwise("Dễ")
    return let(level, F.size(words(question)), F.size(words(solution)))


#: Tags and the words that call for them.
TAG_WORDS = {
    "số học": ("số", "chữ số", "chia hết", "dư", "ước", "bội", "nguyên tố", "trung bình cộng", "tổng", "hiệu", "tích", "thương", "phân số"),
    "hình học": ("tam giác", "vuông", "tròn", "chữ nhật", "hình vuông", "diện tích", "chu vi", "cạnh", "góc", "bán kính", "đường kính", "thể tích", "mét", "cm"),
    "đại số": ("phương trình", "ẩn số", "biến số", "tìm x", "tỷ lệ", "phần trăm", "%", "gấp", "lần", "hệ thức"),
    "chuyển động": ("vận tốc", "quãng đường", "thời gian", "km/h", "xuất phát", "gặp nhau", "ca nô", "ô tô", "xe máy", "xuôi dòng", "ngược dòng"),
    "công việc": ("công việc", "làm chung", "làm riêng", "vòi nước", "bể", "giờ", "hoàn thành", "năng suất"),
    "logic": ("hỏi", "bao nhiêu", "mấy", "tìm", "giải thích", "chứng minh", "suy luận", "đúng", "sai", "so sánh"),
    "thực tế": ("tuổi", "tiền", "kẹo", "cam", "táo", "gà", "thỏ", "nước", "muối", "dung dịch", "học sinh", "lớp học", "cửa hàng", "giảm giá"),
}
#: Tags that a word calls for wherever it stands.
TAG_PARTS = {"tuổi": ("tuổi",), "công việc": ("công việc", "làm chung", "làm riêng", "vòi nước"), "chuyển động": ("vận tốc", "km/h", "quãng đường", "ca nô")}
#: Tags of the extractor by words that stand anywhere, and what the first generator adds to them.
SHORT_TAG_WORDS = {
    "số học": ("số", "chữ số", "ước số", "bội số", "tổng", "hiệu", "tích", "thương"),
    "hình học": ("tam giác", "hình vuông", "hình chữ nhật", "diện tích", "chu vi"),
    "đại số": ("phương trình", "biểu thức", "số x", "nghiệm"),
    "logic": ("nếu", "thì", "hoặc", "và", "suy ra"),
    "thực tế": ("tiền", "tuổi", "giờ", "ngày", "tháng", "năm"),
}
MORE_TAG_WORDS = {
    "số học": ("chia",), "hình học": ("cạnh",), "đại số": ("tỷ số",), "logic": ("chứng minh", "giải thích"), "thực tế": ("cam", "gà", "vịt", "thỏ"),
}


def tag_pattern(words_: Sequence[str]) -> str:
    """Where one of the words stands alone: between blanks or text ends, or before a comma, full stop or question mark."""
    any_ = "(?:" + "|".join(w.replace(".", r"\.") for w in words_) + ")"
    return f"^{any_} | {any_}[ ,.?]| {any_}\\z"


def tags(question: Column) -> Column:
    """Sorted tags whose words stand in a question as words of their own; `tổng hợp` if there is none."""
    low = F.lower(F.coalesce(question, F.lit("")))
    alone = [F.when(low.rlike(tag_pattern(ws)), F.lit(t)) for t, ws in TAG_WORDS.items()]
    parts = [F.when(F.greatest(*(F.contains(low, F.lit(w)) for w in (*ws, ws[0]))), F.lit(t)) for t, ws in TAG_PARTS.items()]
    return let(lambda t: F.when(F.size(t) == 0, F.array(F.lit("tổng hợp"))).otherwise(F.array_sort(t)), F.array_distinct(F.array_compact(F.array(*alone, *parts))))


def short_tags(question: Column, more: bool = False) -> Column:
    """Tags whose words stand anywhere in a question, in the order of the table; none if there is none."""
    low = F.lower(F.coalesce(question, F.lit("")))
    kinds = {t: ws + (MORE_TAG_WORDS[t] if more else ()) for t, ws in SHORT_TAG_WORDS.items()}
    return F.array_compact(F.array(*(F.when(F.greatest(*(F.contains(low, F.lit(w)) for w in ws)), F.lit(t)) for t, ws in kinds.items())))


def length_difficulty(question: Column, solution: Column) -> Column:
    """Difficulty by words of the solution for each word of the question: above 2 hard, above 1.5 middling; an empty question counts 1."""
    level = lambda q, s: F.when(q == 0, "Dễ").when(s > 2 * q, "Khó").when(s > 1.5 * q, "Trung bình").otherwise("Dễ")
    return let(level, F.size(words(question)), F.size(words(solution)))


def normalize_extracted(c: Column) -> Column:
    """Text of a page as one line: one blank after stops and commas, none around brackets."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", " ")
    out = F.regexp_replace(out, r" *([.,!?]) *", "$1 ")
    return F.trim(F.regexp_replace(out, r" *([()\[\]]) *", "$1"))


#: Subjects by patterns in a question, the first that fits.
SUBJECT_PATTERNS = (("arithmetic", r"[0-9]|cộng|trừ|nhân|chia"), ("algebra", "phương trình|ẩn số|biến"), ("geometry", "hình|góc|diện tích|chu vi"), ("logic", "suy luận|logic"))


def subject(question: Column) -> Column:
    low = F.lower(question)
    out = F.when(low.rlike(SUBJECT_PATTERNS[0][1]), SUBJECT_PATTERNS[0][0])
    for name, pattern in SUBJECT_PATTERNS[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("general")


def base_prompt(c: Column) -> Column:
    """A prompt type without the number of samples at its end."""
    return F.regexp_replace(c, "_[0-9]+$", "")


def shots(c: Column) -> Column:
    """The first number in a prompt type."""
    return F.nullif(F.regexp_extract(c, "([0-9]+)", 1), F.lit("")).cast("int")


def prompt_category(c: Column) -> Column:
    """Category of a prompt type; of several that fit, the one listed first here."""
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("few_shot")), "Few-shot").when(F.contains(low, F.lit("zero_shot")), "Zero-shot").when(F.contains(low, F.lit("cot")), "CoT").when(F.contains(low, F.lit("react")), "ReAct").otherwise("Other")


def prompt_classes(c: Column) -> Column:
    """All overlapping classes of a prompt type."""
    low = F.lower(c)
    rules = {"zero_shot": low.startswith("zero_shot"), "few_shot": F.contains(low, F.lit("few_shot")), "cot": F.contains(low, F.lit("cot")), "self_consistency": F.contains(low, F.lit("self_consistency")), "react": F.contains(low, F.lit("react"))}
    return F.array_compact(F.array(*(F.when(r, F.lit(k)) for k, r in rules.items())))
