"""How a response reasons: its steps and calculations, their relevance, and its final answer. All are Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.numbers import clamp01, let, ratio
from scoreloom.functions.text import words

#: What begins a step of reasoning.
STEP_WORDS = "Bước [0-9]+:|Đầu tiên|Tiếp theo|Sau đó|Cuối cùng|Ta có|Áp dụng|Từ đó|Xét|Do đó|Vậy nên|Vì vậy|Khi đó|Theo|Nhận thấy|Giả sử|Suy ra"
#: Statements that can't be.
ILLOGICAL = (
    r"số\s+\w+\s+là\s+âm", r"chia\s+cho\s+0", r"căn\s+bậc\s+\w+\s+của\s+số\s+âm", r"phương\s+trình\s+vô\s+nghiệm.*có.*nghiệm", r"tam\s+giác\s+có\s+góc\s+\w+\s+bằng\s+180",
)
#: Notions of each subject.
ALGEBRA = ("phương trình", "biến số", "hệ số", "đa thức", "bậc", "hàm số", "đạo hàm", "tích phân", "ma trận", "vector")
GEOMETRY = ("góc", "cạnh", "đường thẳng", "tam giác", "tứ giác", "đường tròn", "diện tích", "thể tích", "đường kính", "bán kính")
LOGIC = ("nếu", "thì", "và", "hoặc", "không", "khi và chỉ khi", "suy ra", "tương đương", "phủ định", "mệnh đề")
ORDER = "Trước tiên|Thứ hai|Tiếp theo|Cuối cùng|Kết luận"
CALCULATION = r"([0-9]+\.?[0-9]*)\s*([-+*/])\s*([0-9]+\.?[0-9]*)\s*=\s*([0-9]+\.?[0-9]*)"


def steps(response: Column) -> Column:
    """The steps of a response: each from a step word to the next."""
    return F.regexp_extract_all(response, F.lit(f"(?s)((?:{STEP_WORDS}).*?)(?=(?:{STEP_WORDS})|\\z)"), F.lit(1))


def calculations(response: Column) -> Column:
    """Written calculations: what they give and what they should give; null should be where that is undefined."""
    part = lambda k: F.regexp_extract_all(response, F.lit(CALCULATION), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("a"), part(2).alias("op"), part(3).alias("b"), part(4).alias("given"))

    def one(x: Column) -> Column:
        a, b = x["a"].cast("double"), x["b"].cast("double")
        due = F.when(x["op"] == "+", a + b).when(x["op"] == "-", a - b).when(x["op"] == "*", a * b).otherwise(F.try_divide(a, b))
        return F.struct(x["given"].cast("double").alias("given"), due.alias("due"))

    return F.transform(zipped, one)


def right(calculated: Column) -> Column:
    return F.size(F.filter(calculated, lambda x: F.abs(x["given"] - x["due"]) <= 0.01))


def wrong(calculated: Column) -> Column:
    return F.size(F.filter(calculated, lambda x: F.abs(x["given"] - x["due"]) > 0.01))


def _consistency(s: Column) -> Column:
    """Share of the steps after the first that begin with a number just where the one before ends with one; 0.8 for fewer than two."""
    ends, begins = F.transform(s, lambda x: x.rlike(r"[0-9]\s*\z")), F.transform(s, lambda x: x.rlike(r"^\s*[0-9]"))
    pairs = F.zip_with(F.slice(ends, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(begins, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: a == b)
    return F.when(F.size(s) > 1, F.size(F.filter(pairs, lambda x: x)) / (F.size(s) - 1)).otherwise(0.8)


def quality(response: Column) -> Column:
    """reasoning, consistency, n_wrong, n_steps, complexity of a response."""

    def scores(s: Column, c: Column) -> Column:
        n, m = F.size(s), F.size(c)
        capped = lambda x, top: F.least(F.lit(1.0), x / float(top))
        return F.struct(
            F.least(F.lit(1.0), n / 3.0 + m / 4.0).alias("reasoning"), _consistency(s).alias("consistency"), wrong(c).cast("bigint").alias("n_wrong"), n.cast("bigint").alias("n_steps"),
            (0.4 * capped(F.size(words(response)), 500) + 0.3 * capped(n, 5) + 0.3 * capped(m, 5)).alias("complexity"),
        )

    return let(scores, steps(response), calculations(response))


def _long_words(c: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(words(c), lambda w: F.char_length(w) > 3), F.lower))


def enhanced(response: Column, solution: Column, question: Column) -> Column:
    """relevance, efficiency, n_illogical and enhanced score of a response.

    Relevance is the mean share of the question's and solution's long words that a
    step holds (0.5 without steps); efficiency is the reasoning score less for long
    steps (0 without any); the enhanced score blends reasoning, relevance and
    efficiency by 0.5, 0.3 and 0.2.
    """

    def scores(s: Column, keys: Column, q: Column) -> Column:
        of = lambda x: F.size(F.array_intersect(_long_words(x), keys)) / F.greatest(F.lit(1), F.size(keys))
        total = lambda f: F.aggregate(s, F.lit(0.0), lambda a, x: a + f(x))
        n = F.size(s)
        relevance = F.when(n > 0, total(of) / n).otherwise(0.5)
        efficiency = F.when(n > 0, q["reasoning"] / (1 + total(lambda x: F.size(words(x)).cast("double")) / n / 50.0)).otherwise(0.0)
        return let(lambda r, e: F.struct(r.alias("relevance"), e.alias("efficiency"), (0.5 * q["reasoning"] + 0.3 * r + 0.2 * e).alias("enhanced")), relevance, efficiency)

    keys = F.array_union(_long_words(F.coalesce(question, F.lit(""))), _long_words(F.coalesce(solution, F.lit(""))))
    return let(scores, steps(response), keys, quality(response))


def illogical(response: Column) -> Column:
    """How many of the statements that can't be occur."""
    low = F.lower(response)
    return sum((low.rlike(f"(?u){p}").cast("int") for p in ILLOGICAL), F.lit(0)).cast("bigint")


def _share(low: Column, notions: Sequence[str], enough: int) -> Column:
    return F.least(F.lit(1.0), sum((F.contains(low, F.lit(n)).cast("int") for n in notions), F.lit(0)) / float(enough))


def subject_score(response: Column, subject: Column) -> Column:
    """Score by the criteria of a subject; 0.5 for others."""
    low = F.lower(response)
    share = lambda p, enough: F.least(F.lit(1.0), F.regexp_count(response, F.lit(p)) / float(enough))
    arithmetic = let(lambda c: ratio(right(c), F.size(c)), calculations(response))
    algebra = 0.6 * _share(low, ALGEBRA, 3) + 0.4 * share("=>|⟹|→|=|⟺", 5)
    # Formulas are looked for in lower case, so that S = and the like are never found, only the word is.
    geometry = 0.7 * _share(low, GEOMETRY, 3) + 0.3 * F.contains(low, F.lit("công thức")).cast("int")
    logic = 0.5 * _share(low, LOGIC, 4) + 0.5 * share(ORDER, 3)
    return F.when(subject == "arithmetic", arithmetic).when(subject == "algebra", algebra).when(subject == "geometry", geometry).when(subject == "logic", logic).otherwise(0.5)


#: What stands before the final answer, by kind of prompt; the first that occurs counts.
SHORT_MARKERS = (r"đáp án:?\s*", r"vậy đáp án là:?\s*", r"kết quả là:?\s*", r"kết luận:?\s*")
COT_MARKERS = (
    r"vậy đáp án là:?\s*", r"kết quả là:?\s*", r"đáp án:?\s*", r"vậy?[,\s]*kết quả:?\s*", r"vậy?[,\s]*kết luận:?\s*", r"kết luận:?\s*", r"do đó[,\s]*đáp án:?\s*", r"do đó[,\s]*",
)
VOTED_MARKERS = (r"đáp án:?\s*", r"kết quả:?\s*", r"vậy đáp án là:?\s*", r"vậy kết quả là:?\s*", r"kết luận:?\s*", r"[0-9]+\.\s*đáp án:?\s*")
REACT_MARKERS = (
    r"đáp án cuối cùng:?\s*", r"final answer:?\s*", r"kết quả cuối cùng:?\s*", r"kết luận cuối cùng:?\s*", r"đáp án:?\s*", r"kết quả:?\s*", r"kết luận:?\s*",
)


def strip(c: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def _after(low: Column, markers: Sequence[str], to: str) -> Column:
    """What follows the first marker in order that occurs, up to the text's or the line's end; null if none does."""
    out = None
    for m in markers:
        p = f"(?su){m}(.*?){to}"
        out = F.when(low.rlike(p), F.regexp_extract(low, p, 1)) if out is None else out.when(low.rlike(p), F.regexp_extract(low, p, 1))
    return strip(out)


def _voted(low: Column) -> Column:
    """The answer that the ways of solution give most often; of equally frequent ones the first found."""
    found = F.concat(*(F.transform(F.regexp_extract_all(low, F.lit(rf"(?su)(?:^|\n){m}(.*?)(?:\n|\z)"), F.lit(1)), strip) for m in VOTED_MARKERS))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))

    def most(a: Column) -> Column:
        ranked = F.transform(F.array_distinct(a), lambda x: F.struct(count(a, x).alias("n"), (-F.array_position(a, x)).alias("first"), x.alias("x")))
        return F.when(F.size(a) > 0, F.array_max(ranked)["x"])

    concluded = F.try_element_at(F.regexp_extract_all(low, F.lit(r"(?su)(?:vậy|do đó)[,\s]*(.*?)(?:\n|\z)"), F.lit(1)), F.lit(-1))
    return F.coalesce(let(most, found), strip(concluded))


def answer_by_prompt(response: Column, prompt: Column) -> Column:
    """The final answer of a response by its kind of prompt: after a marker, by vote of several ways, or its last sentence or line."""

    def of(c: Column) -> Column:
        low = F.lower(c)
        whole = strip(c)
        sentence = strip(F.element_at(F.split(c, "[.!?]"), -1))
        line = F.element_at(F.split(whole, "\n"), -1)
        end, to_line = r"\z", r"(?:\n|\z)"
        return (
            F.when(prompt == "zero_shot", F.coalesce(_after(low, SHORT_MARKERS, end), whole))
            .when(prompt.startswith("few_shot_"), F.coalesce(_after(low, SHORT_MARKERS, end), sentence))
            .when((prompt == "cot") | prompt.startswith("cot_"), F.coalesce(_after(low, COT_MARKERS, end), sentence))
            .when(prompt.startswith("self_consistency_"), F.coalesce(_voted(low), line))
            .when(prompt == "react", F.coalesce(_after(low, REACT_MARKERS, to_line), line))
            .otherwise(whole)
        )

    return let(of, F.coalesce(response, F.lit("")))


#: What begins the conclusion of a response, and the frame of a structured one.
CONCLUSIONS = ("therefore", "thus", "so the answer is", "the answer is", "finally")
FRAME = (
    "THINK: Let me think through this problem step by step.\n",
    "ACTION: I need to calculate the answer based on my reasoning.\n",
    "OBSERVATION: After calculating, I can see the result.\n\n",
    "THINK: Based on my calculations and observations, I can determine the answer.\n",
)


def structured(response: Column) -> Column:
    """A response in the frame of thinking, acting and observing; its lines from the first concluding one on come last."""

    def framed(lines: Column) -> Column:
        concludes = lambda x: F.greatest(*(F.contains(F.lower(x), F.lit(w)) for w in CONCLUSIONS))
        first = F.array_position(F.transform(lines, concludes), True)
        before = F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)
        after = F.when(first > 0, F.slice(lines, first.cast("int"), F.size(lines)))
        thought = F.when(F.size(before) > 0, F.concat(F.array_join(before, "\n"), F.lit("\n\n"))).otherwise("")
        end = F.coalesce(F.array_join(after, "\n"), F.concat(F.lit("The answer is: "), F.trim(F.element_at(F.split(response, r"\."), -1))))
        return F.concat(F.lit(FRAME[0]), thought, F.lit(FRAME[1] + FRAME[2] + FRAME[3]), end)

    return let(framed, F.filter(F.transform(F.split(response, "\n"), F.trim), lambda x: x != ""))


def blended(correctness: Column, reasoning: Column) -> Column:
    """0.6 of correctness and 0.4 of reasoning, within 0 and 1."""
    return clamp01(0.6 * correctness + 0.4 * reasoning)
