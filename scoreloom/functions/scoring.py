"""Scores of one response against its reference, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions import udfs
from scoreloom.functions.numbers import clamp01, let, number_equal, ratio
from scoreloom.functions.text import clean_text, collapse, numbers, words

#: Words that a relaxed match ignores.
RELAXED_STOP = ("là", "và", "được", "có", "trong", "của", "các", "những", "với")


def exact_match(a: Column, b: Column) -> Column:
    """Whether two texts are equal once cleaned; null if one is null."""
    return F.when(a.isNotNull() & b.isNotNull(), clean_text(a) == clean_text(b))


def relaxed(c: Column) -> Column:
    """A cleaned text without other signs and without the words a relaxed match ignores."""
    plain = F.regexp_replace(clean_text(c), "[^a-zA-Z0-9 \\u00C0-\\u1EF9]", "")
    return F.array_join(F.filter(words(plain), lambda w: ~w.isin(*RELAXED_STOP)), " ")


def _shared(a: Column, b: Column, n: int = 1) -> Column:
    """shared, n_a and n_b of the cleaned texts' n-grams."""
    return udfs.overlap(n)(clean_text(a), clean_text(b))


def relaxed_match(a: Column, b: Column) -> Column:
    """Equality, containment either way, or 80 % of the smaller set of words of 3 letters or more in common."""
    long = lambda c: F.array_distinct(F.filter(words(c), lambda w: F.char_length(w) >= 3))

    def common(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x, y))
        return (shared > 0) & (shared >= 0.8 * F.least(F.size(x), F.size(y)))

    same = let(lambda p, r: (p == r) | F.contains(p, r) | F.contains(r, p) | let(common, long(p), long(r)), relaxed(a), relaxed(b))
    return F.when(a.isNotNull() & b.isNotNull(), same)


def _prf(shared: Column, n: Column, m: Column, name: str) -> Column:
    def scores(k: Column, x: Column, y: Column) -> Column:
        p, r = ratio(k, x), ratio(k, y)
        return F.struct(p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias(name))

    return let(scores, shared, n, m)


def token_overlap(a: Column, b: Column) -> Column:
    """precision, recall and f1 of shared words, counted with repetition; null if one text has none."""
    return let(lambda o: F.when((o["n_a"] > 0) & (o["n_b"] > 0), _prf(o["shared"], o["n_a"], o["n_b"], "f1")), _shared(a, b))


def fallback_f1(a: Column, b: Column) -> Column:
    """F1 where no word is shared: equality of texts of three words or less, else F1 of different words or, without common ones, of
    characters, times the ratio of their numbers of words. Signs count as blanks."""
    letters = lambda x: F.array_distinct(F.filter(F.split(F.array_join(x, " "), ""), lambda t: t != ""))
    dice = lambda x, y: ratio(2 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y))

    def score(p: Column, r: Column) -> Column:
        by_words = let(dice, F.array_distinct(p), F.array_distinct(r))
        lengths = ratio(F.least(F.size(p), F.size(r)), F.greatest(F.size(p), F.size(r)))
        short = (F.size(p) <= 3) & (F.size(r) <= 3)
        equal = (F.array_join(p, " ") == F.array_join(r, " ")).cast("double")
        rest = F.when(by_words > 0, by_words).otherwise(let(dice, letters(p), letters(r))) * lengths
        return F.when((F.size(p) == 0) | (F.size(r) == 0), 0.0).when(short, equal).otherwise(rest)

    plain = lambda c: words(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}_\s]", " "))
    return let(score, plain(a), plain(b))


def rouge_n(candidate: Column, reference: Column, n: int) -> Column:
    """precision, recall and f of shared n-grams, without stemming; 0 if there are none."""
    return let(lambda o: _prf(o["shared"], o["n_a"], o["n_b"], "f"), _shared(candidate, reference, n))


def bleu_n(candidate: Column, reference: Column, n: int) -> Column:
    """BLEU of one order: clipped n-gram precision with the brevity penalty."""
    # A text of w words has w - n + 1 n-grams; those of shorter texts match nothing.
    brevity = lambda o: F.when(o["n_a"] >= o["n_b"], 1.0).when(o["n_a"] == 0, 0.0).otherwise(F.exp(1 - (o["n_b"] + n - 1) / (o["n_a"] + n - 1)))
    return let(lambda o: brevity(o) * ratio(o["shared"], o["n_a"]), _shared(candidate, reference, n))


def meteor_unigram(candidate: Column, reference: Column, alpha: float = 0.9) -> Column:
    """The weighted mean of unigram precision and recall by which METEOR falls back."""
    mean = lambda p, q: ratio(p * q, alpha * p + (1 - alpha) * q)
    return let(lambda o: let(mean, ratio(o["shared"], o["n_a"]), ratio(o["shared"], o["n_b"])), _shared(candidate, reference))


def any_number_match(response: Column, expected: Column, tolerance: float = 0.02) -> Column:
    """Whether any number of the response is one of the expected answer."""
    return let(lambda x, y: F.exists(x, lambda a: F.exists(y, lambda b: number_equal(a, b, tolerance))), numbers(response), numbers(expected))


def count_of(c: Column, text: str) -> Column:
    """How often a text occurs, without overlap."""
    return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(text), F.lit("")))) / len(text)).cast("bigint")


def share_of(c: Column, markers: Sequence[str], least: int = 1) -> Column:
    """Share of the markers that occur, of at least `least`."""
    hits = sum((F.contains(c, F.lit(m)).cast("int") for m in markers), F.lit(0))
    return hits / float(max(least, len(markers)))


#: Markers of steps, reasons, confidence and doubt.
STEP_MARKERS = ("bước", "step", "first", "thứ nhất", "tiếp theo", "sau đó", "cuối cùng")
MATH_MARKERS = ("=", "+", "-", "*", "/", "×", "÷", "tính toán", "phương trình")
REASON_MARKERS = ("vì", "do đó", "vậy", "nên", "bởi vì", "dẫn đến", "suy ra")
CONFIDENT = ("chắc chắn", "dứt khoát", "rõ ràng", "không còn nghi ngờ gì", "hiển nhiên", "kết quả là", "vậy", "vì vậy", "do đó", "kết luận", "có thể khẳng định", "khẳng định")
DOUBTFUL = (
    "có lẽ", "có thể", "không chắc", "tôi nghĩ", "dường như", "không rõ", "chưa chắc", "tôi đoán", "tôi tin", "tôi cho rằng",
    "tôi ước tính", "không biết", "không dám chắc", "bối rối", "phức tạp", "khó",
)
EXAMPLE_MARKERS = ("tương tự", "giống như", "theo cách tương tự", "áp dụng")
CONSISTENT_MARKERS = ("nhất quán", "consistent", "phương pháp", "giải", "solution")
STRUCTURE_MARKERS = ("đáp án", "kết quả", "trả lời", "solution", "answer")
STEP_COUNTED = ("bước", "step", "thứ nhất", "thứ hai", "first", "second")


def _any(c: Column, markers: Sequence[str]) -> Column:
    return F.greatest(*(F.contains(c, F.lit(m)) for m in markers))


def confidence(response: Column) -> Column:
    """Share of confident markers among all that occur, more with a number near the end, less for very long texts."""
    low = F.lower(response)
    high = sum((F.contains(low, F.lit(m)).cast("int") for m in CONFIDENT), F.lit(0))
    doubt = sum((F.contains(low, F.lit(m)).cast("int") for m in DOUBTFUL), F.lit(0))
    score = F.when(high + doubt == 0, 0.5).otherwise(high / (high + doubt))
    parts = F.split(response, r"\.")
    end = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), ".")
    score = F.when(end.rlike("[0-9]"), F.least(F.lit(1.0), score + 0.2)).otherwise(score)
    return F.when(F.size(words(response)) > 300, F.greatest(F.lit(0.1), score - 0.1)).otherwise(score)


def prompt_reasoning(response: Column, prompt: Column) -> Column:
    """How well a response reasons, judged by the markers its kind of prompt calls for."""
    low, kind = F.lower(response), F.lower(prompt)
    cot = 0.4 * F.least(share_of(low, STEP_MARKERS, 4), F.lit(1.0)) + 0.3 * share_of(response, MATH_MARKERS, 3) + 0.3 * share_of(low, REASON_MARKERS, 3)
    ordered = (F.contains(low, F.lit("bước 1")) & F.contains(low, F.lit("bước 2"))) | (F.contains(low, F.lit("thứ nhất")) & F.contains(low, F.lit("thứ hai")))
    cot = cot + 0.1 * ordered.cast("int") + 0.1 * _any(low, ("kết luận", "vậy", "do đó", "conclusion")).cast("int")
    think, act = _any(low, ("think:", "suy nghĩ:", "suy nghĩ rằng", "tôi cần")), _any(low, ("act:", "hành động:", "tôi sẽ", "tiến hành"))
    seen = _any(low, ("observe:", "quan sát:", "kết quả là", "nhận thấy"))
    react = F.when(think & act & seen, 0.9).when(think & act, 0.7).when(think, 0.5).otherwise(0.3)
    react = react + 0.1 * (F.least(count_of(low, "think:"), count_of(low, "act:")) >= 2).cast("int")
    voted = 0.6 + 0.4 * share_of(low, CONSISTENT_MARKERS)
    few = 0.5 + 0.3 * share_of(low, EXAMPLE_MARKERS) + 0.2 * _any(low, ("đáp án", "kết quả")).cast("int")
    zero = 0.5 + 0.5 * share_of(low, STRUCTURE_MARKERS)
    has = lambda t: F.contains(kind, F.lit(t))
    return clamp01(F.when(has("cot"), cot).when(has("react"), react).when(has("self_consistency"), voted).when(has("few_shot"), few).when(has("zero_shot"), zero).otherwise(0.5))


def step_count(response: Column) -> Column:
    low = F.lower(response)
    return sum((count_of(low, m) for m in STEP_COUNTED), F.lit(0).cast("bigint"))


def react_cycles(response: Column) -> Column:
    """Complete cycles of thinking, acting and observing."""
    low = F.lower(response)
    both = lambda a, b: count_of(low, a) + count_of(low, b)
    return F.least(both("think:", "suy nghĩ:"), both("act:", "hành động:"), both("observe:", "quan sát:"))


def react_actions(response: Column) -> Column:
    """The texts of all actions, joined by `; `."""
    low = F.lower(response)
    a = F.regexp_extract_all(low, F.lit(r"(?s)act:(.*?)(?:think:|observe:|$)"), F.lit(1))
    b = F.regexp_extract_all(low, F.lit(r"(?su)hành động:(.*?)(?:suy nghĩ:|quan sát:|$)"), F.lit(1))
    return F.array_join(F.filter(F.transform(F.concat(a, b), F.trim), lambda x: x != ""), "; ")


def bias_correction(prompt: Column, correctness: Column, reasoning: Column, length: Column) -> Column:
    cot = -0.05 * F.least(F.lit(0.1), length / 5000.0) + F.when(reasoning > 0.7, 0.05).otherwise(0.0)
    hybrid = F.when((reasoning > 0.6) & (correctness > 0.7), 0.03).otherwise(0.0)
    return F.when(prompt == "standard", 0.05).when(prompt == "cot", cot).when(prompt == "hybrid_cot", hybrid).otherwise(0.0)


def final_score(prompt: Column, correctness: Column, reasoning: Column, consistency: Column, efficiency: Column, confidence_: Column, bias: Column) -> Column:
    """Weighted blend of the scores, by the kind of prompt, with the correction, within 0 and 1."""
    blend = lambda *w: sum((F.coalesce(c, F.lit(0.0)) * x for c, x in zip((correctness, reasoning, consistency, efficiency, confidence_), w)), F.lit(0.0))
    mixed = F.when(prompt == "cot", blend(0.45, 0.25, 0.15, 0.10, 0.05)).when(prompt == "hybrid_cot", blend(0.35, 0.25, 0.15, 0.15, 0.10)).otherwise(blend(0.9, 0.1, 0.0, 0.0, 0.0))
    return clamp01(mixed + F.coalesce(bias, F.lit(0.0)))


def first_object(c: Column) -> Column:
    """The first JSON object of a text that may hold several run together."""
    return F.nullif(F.regexp_extract(c, r"\{[^{}]*\}", 0), F.lit(""))


#: Names of a judge's criteria in its lines `name: n/5`, in two sets, and of their average.
CRITERIA_NAMES = {
    "accuracy": "Accuracy|Độ chính xác", "reasoning": "Reasoning|Suy luận|Độ suy luận", "completeness": "Completeness|Tính đầy đủ",
    "explanation": "Explanation|Giải thích", "cultural_context": "Cultural context|Ngữ cảnh văn hóa",
}
FIVE_CRITERIA_NAMES = {
    "logical_flow": "Tính hợp lý|Độ hợp lý|Logical flow|Tính logic", "mathematical_correctness": "Độ chính xác về mặt toán học|Mathematical correctness|Tính toán chính xác",
    "clarity": "Rõ ràng|Độ rõ ràng|Clarity", "completeness": "Tính đầy đủ|Đầy đủ|Completeness", "relevance": "Mức độ liên quan|Tính liên quan|Relevance",
}
AVERAGE_NAMES = "Average|Trung bình|Điểm trung bình|Average score|Avg score"


def judge_scores(c: Column, criteria: dict[str, str] | Sequence[str], average: str = AVERAGE_NAMES) -> Column:
    """A judge's scores: those of its first JSON object, or without one those of lines `name: n/5`; 0 where none is given.

    `average` is the one given, else the mean of the positive scores. Null text gives
    null scores.
    """
    names = criteria if isinstance(criteria, dict) else {k: k for k in criteria}
    number = lambda text: F.coalesce(text.try_cast("double"), F.lit(0.0))
    by_line = lambda p: F.nullif(F.regexp_extract(c, rf"(?isu)(?:{p}).*?([0-9]+(?:\.[0-9]+)?)[/\s]*5", 1), F.lit(""))

    def scores(m: Column) -> Column:
        value = lambda k, p: F.when(m.isNotNull(), number(F.try_element_at(m, F.lit(k)))).otherwise(number(by_line(p)))
        given = [value(k, p).alias(k) for k, p in names.items()]

        def with_mean(s: Column) -> Column:
            positive = F.filter(F.array(*(s[k] for k in names)), lambda x: x > 0)
            mean = F.when(F.size(positive) > 0, F.aggregate(positive, F.lit(0.0), lambda a, x: a + x) / F.size(positive)).otherwise(0.0)
            return F.struct(*(s[k].alias(k) for k in names), F.when(s["average"] != 0, s["average"]).otherwise(mean).alias("average"))

        return let(with_mean, F.struct(*given, value("average", average).alias("average")))

    return F.when(c.isNotNull(), let(scores, F.from_json(first_object(c), "map<string,string>")))


def judge_explanation(c: Column) -> Column:
    """What follows `explanation:` up to a numbered line, or the JSON's explanation."""
    by_json = F.get_json_object(first_object(c), "$.explanation")
    return F.coalesce(by_json, F.nullif(F.trim(F.regexp_extract(c, r"(?isu)(?:Giải thích|Explanation)\s*:(.*?)(?:\z|(?=\n\s*[0-9]))", 1)), F.lit("")))


def second_judge(c: Column) -> Column:
    """quality, correctness (of ten, as 0..1) and feedback of the lines `Reasoning_Quality:`, `Correctness:` and `Feedback:`; null where missing."""
    line = lambda name: F.nullif(F.trim(F.regexp_extract(c, rf"(?m)^.*{name}:[ \t]*([^:\n]*)", 1)), F.lit(""))
    tenth = lambda name: line(name).try_cast("double") / 10
    feedback = F.nullif(F.trim(F.regexp_extract(c, r"(?s)Feedback:(.*)", 1)), F.lit(""))
    return F.struct(tenth("Reasoning_Quality").alias("quality"), tenth("Correctness").alias("correctness"), feedback.alias("feedback"))


def completeness_score(c: Column) -> Column:
    """A judge's `score: n/10` as 0..1; 5.0, unscaled, where none is given."""
    low = F.lower(c)
    number = F.coalesce(*(F.nullif(F.regexp_extract(low, p, 1), F.lit("")).try_cast("double") for p in (r"(?:điểm|score)[^0-9]*([0-9]+(?:\.[0-9]+)?)/10", r"(?:điểm|score)[^0-9]*([0-9]+(?:\.[0-9]+)?)")))
    return F.coalesce(clamp01(number / 10), F.lit(5.0))


#: Error classes and the words that name them, in order.
ERROR_WORDS = {
    "Knowledge Error": ("knowledge", "kiến thức", "thiếu thông tin", "incorrect knowledge"),
    "Reasoning Error": ("reasoning", "suy luận", "logic", "logical", "reasoning process"),
    "Calculation Error": ("calculation", "tính toán", "mathematical", "computational", "số học"),
    "Non-answer": ("non-answer", "không trả lời", "refusing", "failing", "từ chối"),
    "Off-topic": ("off-topic", "lạc đề", "unrelated", "không liên quan"),
    "Misunderstanding": ("misunderstanding", "hiểu nhầm", "misinterpreting", "misinterpretation"),
    "Other": ("other", "khác"),
}


def error_class(c: Column) -> Column:
    """The first class whose words occur, else the one of a leading number, else Other."""
    low = F.lower(c)
    out = None
    for name, ws in ERROR_WORDS.items():
        out = F.when(_any(low, ws), name) if out is None else out.when(_any(low, ws), name)
    for k, name in enumerate(ERROR_WORDS, 1):
        out = out.when(low.startswith(str(k)), name)
    return out.otherwise("Other")


def error_analysis(c: Column) -> Column:
    """error_type and explanation from a judge's lines; `Unknown` and the whole text without them."""
    kind = F.coalesce(*(F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")) for p in (r"(?iu)(?:Loại lỗi|Error Type):\s*([^\n]*)", r"(?iu)(?:lỗi|error):\s*([^\n]*)")))
    why = F.nullif(F.trim(F.regexp_extract(c, r"(?isu)(?:Giải thích|Brief Explanation|explanation):\s*(.*)", 1)), F.lit(""))
    return F.struct(F.when(kind.isNotNull(), error_class(kind)).otherwise("Unknown").alias("error_type"), F.coalesce(why, c).alias("explanation"))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return ratio(dot, norm(a) * norm(b))
