import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import answers, reasoning, udfs
from scoreloom.functions import scoring as sc
from scoreloom.functions import text as tx


def checked(spark, cases, lenient=False):
    df = spark.createDataFrame([(i, r, e, t) for i, (r, e, t) in enumerate(cases)], "i int, r string, e string, t string")
    out = df.select("i", answers.checked(F.col("r"), F.col("e"), F.col("t"), lenient).alias("x")).orderBy("i").select("x.*").collect()
    return [(r.found, r.by, r.kind) for r in out]


def test_each_kind_of_question(spark):
    cases = [
        ("Có 100 quả", "101", None, (True, "number", None)), ("0", "0.01", None, (True, "number", None)), ("", "5", None, (False, None, None)), (None, "5", "x", (False, None, None)),
        ("mất tất cả 9 giờ", "xong sau 5 giờ", "Bài toán công việc", (False, None, "work")),
        ("không có số nào", "Không tồn tại", "Số học", (True, "kind", "number")), ("là 12", "không có số thỏa mãn", "Số học", (False, None, "number")),
        ("đáp số 1.500 đồng", "1500 đồng", "Từ vựng", (True, "kind", "money")), ("đáp số 1.600 đồng", "1500 đồng", "Từ vựng", (False, None, "money")),
        ("diện tích: 12 và chu vi: 99", "tính diện tích và chu vi: diện tích: 50, chu vi: 70", None, (False, None, "geometry")),
        ("tổng = 6/8", "tổng = 3/4", "phân số", (True, "kind", "fraction")), ("tổng = 7/9", "tổng = 1/4", "phân số", (False, None, "fraction")),
        ("sẽ đầy sau 97,4 phút", "hồ nước đầy sau 100 phút", None, (True, "kind", "pool")), ("sẽ đầy sau 90 phút", "hồ nước đầy sau 100 phút", None, (False, None, "pool")),
        ("chia được 3 dư 9", "chia được 5 và dư 2", None, (False, None, "shares")), ("mỗi người 7 viên", "x viên kẹo 9", "chia kẹo", (False, None, "candy")),
        ("thưa cô em nghĩ là mèo đen", "con mèo đen", None, (False, None, None)), ("đó là con mèo màu đen", "con mèo đen", None, (True, "text", None)), ("kết quả: con mèo đen.", "con mèo đen", None, (True, "text", None)),
        ("5 năm", "9 tuổi sau 2 năm", "tuổi", (False, None, "age")), ("x = 7", "cần thêm 3 g dung dịch", None, (False, None, "mixture")), ("sau 2 giờ", "vận tốc là 9", None, (False, None, "motion")),
    ]
    for (r, e, t, want), got in zip(cases, checked(spark, [c[:3] for c in cases])):
        assert got == want, (r, e, t)
    assert checked(spark, [("sau 2 giờ", "vận tốc là 9", None), ("là 12", "không có số thỏa mãn", "Số học"), ("là 12", "tìm số 90", None)], True) == [
        (True, "kind", "motion"), (False, None, "number"), (True, "kind", "number"),
    ]


def test_numbers_against_brute_force(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["12", "12,1", "-3", "0", "0.01", "7.", "sai", "đúng", "1000", "1019"]) for _ in range(rng.randrange(0, 4)))

    def equal(a, b):
        return a == b == 0 or abs(a - b) <= 0.02 * (max(abs(a), abs(b)) if max(abs(a), abs(b)) > 1 else 1)

    cases = [(text(), text(), None) for _ in range(300)]
    for (r, e, _), (found, by, _) in zip(cases, checked(spark, cases)):
        given, wanted = ([float(x.replace(",", ".")) for x in re.findall(r"-?\d+[.,]?\d*", t)] for t in (r, e))
        number = any(equal(a, b) for a in given for b in wanted)
        ws, es = set(r.split()), set(e.split())
        text_match = bool(e) and bool(r) and (e in r or len(ws & es) >= 0.7 * len(es))
        assert (found, by) == ((True, "number") if number else (True, "text") if text_match else (False, None)), (r, e)


STEP = r"(?:Bước \d+:|Đầu tiên|Tiếp theo|Do đó|Ta có)"


def test_reasoning_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["Bước 1: tính 2 + 2 = 4", "Tiếp theo 3 * 3 = 8", "Do đó còn 5", "Ta có 12", "rồi thôi.\n", "Đầu tiên xét 9 / 0 = 1", "Bước 12: chia cho 0"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(0, 7))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    out = df.select("i", reasoning.quality(F.col("c")).alias("q"), reasoning.enhanced(F.col("c"), F.lit("chia thôi nhé mọi người"), F.lit("tính toán")).alias("e"), reasoning.illogical(F.col("c")).alias("z")).orderBy("i").collect()
    keys = {"thôi", "người", "chia", "tính", "toán"}
    for t, r in zip(texts, out):
        steps = re.findall(f"{STEP}.*?(?={STEP}|$)", t, re.S)
        # A step ends before the next or at the text's end.
        steps = [m for m in re.findall(rf"{STEP}.*?(?={STEP}|\Z)", t, re.S)]
        sums = re.findall(r"(\d+\.?\d*)\s*([-+*/])\s*(\d+\.?\d*)\s*=\s*(\d+\.?\d*)", t)
        due = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b if b else math.nan}
        wrong = sum(abs(float(d) - due[o](float(a), float(b))) > 0.01 for a, o, b, d in sums)
        assert (r.q.n_steps, r.q.n_wrong) == (len(steps), wrong)
        assert r.q.reasoning == pytest.approx(min(1, len(steps) / 3 + len(sums) / 4))
        same = [bool(re.search(r"\d\s*\Z", a)) == bool(re.search(r"^\s*\d", b)) for a, b in zip(steps, steps[1:])]
        assert r.q.consistency == pytest.approx(sum(same) / len(same) if same else 0.8)
        assert r.q.complexity == pytest.approx(0.4 * min(1, len(t.split()) / 500) + 0.3 * min(1, len(steps) / 5) + 0.3 * min(1, len(sums) / 5))
        share = [len({w.lower() for w in s.split() if len(w) > 3} & keys) / len(keys) for s in steps]
        relevance = sum(share) / len(share) if share else 0.5
        size = sum(len(s.split()) for s in steps) / len(steps) if steps else 0
        efficiency = r.q.reasoning / (1 + size / 50) if steps else 0.0
        assert (r.e.relevance, r.e.efficiency) == (pytest.approx(relevance), pytest.approx(efficiency))
        assert r.e.enhanced == pytest.approx(0.5 * r.q.reasoning + 0.3 * relevance + 0.2 * efficiency)
        assert r.z == ("chia cho 0" in t)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_subject_scores(spark):
    score = lambda t, s: one(spark, reasoning.subject_score(F.lit(t), F.lit(s)))
    assert score("2 + 2 = 4; 2 * 3 = 7", "arithmetic") == 0.5 and score("không có", "arithmetic") == 0.0
    assert score("phương trình bậc hai = 4 → 2", "algebra") == pytest.approx(0.6 * 2 / 3 + 0.4 * 2 / 5)
    assert score("Góc và cạnh của tam giác, công thức S = 3", "geometry") == pytest.approx(1.0)
    assert score("Nếu a thì b. Kết luận: không", "logic") == pytest.approx(0.5 * 3 / 4 + 0.5 / 3) and score("x", "general") == 0.5


def test_final_answers_by_prompt(spark):
    of = lambda t, p: one(spark, reasoning.answer_by_prompt(F.lit(t), F.lit(p)))
    assert of("Giải: ...\nĐáp án: 12 quả\n", "zero_shot") == "12 quả" and of(" chỉ có vậy ", "zero_shot") == "chỉ có vậy"
    assert of("Một. Hai", "few_shot_3") == "Hai" and of("x\nKết quả là 5", "few_shot_3") == "5"
    assert of("a. Do đó, b\nc", "cot") == "b\nc" and of("đáp án: 1. Vậy đáp án là 2", "cot_self_consistency_3") == "2"
    assert of("Đáp án: 4\nCách 2\nĐáp án: 5\nCách 3\nKết luận: 5", "self_consistency_3") == "5" and of("Đáp án: 4\nĐáp án: 6", "self_consistency_3") == "4"
    assert of("a\nVậy là ba\nhết", "self_consistency_5") == "là ba" and of("một\nhai", "self_consistency_5") == "hai"
    assert of("Đáp án: 3\nFinal answer: 7 kg\nz", "react") == "7 kg" and of("a\nb", "react") == "b" and of(" q ", "other") == "q"
    assert one(spark, reasoning.answer_by_prompt(F.lit(None).cast("string"), F.lit("cot"))) == ""


def test_structured_and_voted_reasoning(spark):
    text = one(spark, reasoning.structured(F.lit("a = 1\n\nThus it is 1.\nend")))
    assert text.startswith("THINK: ") and "step.\na = 1\n\nACTION: " in text and text.endswith("answer.\nThus it is 1.\nend")
    assert one(spark, reasoning.structured(F.lit("a. b"))).endswith("The answer is: b")
    assert one(spark, sc.prompt_reasoning(F.lit("Ta giải nhất quán"), F.lit("self_consistency_3"))) == pytest.approx(0.6 + 0.4 * 2 / 5)
    assert one(spark, sc.prompt_reasoning(F.lit("x"), F.lit("cot_self_consistency_3"))) < 0.5


def test_fallback_f1(spark):
    f = lambda a, b: one(spark, sc.fallback_f1(F.lit(a), F.lit(b)))
    assert f("A, b!", "a b") == 1.0 and f("a b", "b a") == 0.0 and f("", "a") == 0.0
    assert f("a b c d", "a x y z w v") == pytest.approx(2 * 1 / 10 * 4 / 6)
    a, b = set("ab cd ef gh"), set("ba dc fe hg ij")
    assert f("ab cd ef gh", "ba dc fe hg ij") == pytest.approx(2 * len(a & b) / (len(a) + len(b)) * 4 / 5)


def test_linear_overlap_and_cosine(spark):
    rng = random.Random(5)
    rows = [(" ".join(rng.choices("abcde", k=rng.randrange(0, 9))), " ".join(rng.choices("abcde", k=rng.randrange(0, 9)))) for _ in range(60)] + [(None, "a")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    for r in df.select("a", "b", udfs.overlap(2)("a", "b").alias("o"), udfs.cosine_counts("a", "b").alias("c")).collect():
        p, q = (Counter(zip(t.split(), t.split()[1:])) for t in (r.a or "", r.b))
        assert (r.o.shared, r.o.n_a, r.o.n_b) == ((p & q).total(), p.total(), q.total())
        u, v = Counter((r.a or "").split()), Counter(r.b.split())
        size = math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))
        assert r.c == pytest.approx(sum(u[w] * v[w] for w in u) / size if size else 0.0)


def test_text_metrics_of_equal_and_empty_texts(spark):
    same = dict(zip(udfs.METRICS, udfs.text_metrics_of("a b c d e", "a b c d e")))
    assert all(v == pytest.approx(1.0, abs=0.01) for v in same.values())
    assert set(udfs.text_metrics_of("", "a")) == {0.0} and set(udfs.text_metrics_of(None, None)) == {0.0}
    some = dict(zip(udfs.METRICS, udfs.text_metrics_of("a b c", "a x c d")))
    assert (some["rouge1_p"], some["rouge1_r"], some["rouge2_f"], some["rougel_p"]) == (pytest.approx(2 / 3), 0.5, 0.0, pytest.approx(2 / 3))
    assert some["bleu1"] == pytest.approx(2 / 3 * math.exp(1 - 4 / 3))


def test_pluggable_encoders():
    table = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [1.0, 1.0]}
    encode = lambda tokens: [sum(table[t][k] for t in tokens) for k in (0, 1)]
    p, r, f = udfs.token_similarity_of(["a", "a", "b"], ["a", "c"], encode)
    half = math.sqrt(0.5)
    assert (p, r) == (pytest.approx((1 + 1 + half) / 3), pytest.approx((1 + half) / 2)) and f == pytest.approx(2 * p * r / (p + r))
    assert udfs.token_similarity_of([], ["a"]) == (0.0, 0.0, 0.0) and udfs.token_similarity_of(["xyz"], ["xyz"])[2] == pytest.approx(1.0)


def test_normal_forms(spark):
    for text in ("ｘ²＋ﬁ", "Tiếng", None, "", "Bài ①"):
        plain = unicodedata.normalize("NFKC", text or "").lower()
        want = " ".join(re.sub(r"\d+", "", "".join(c for c in plain if c not in tx.PUNCTUATION)).split(" ")).strip()
        assert one(spark, tx.clean_text(F.lit(text).cast("string"), numbers=True, unicode=True)) == want


def test_judges(spark):
    of = lambda t: one(spark, sc.judge_scores(F.lit(t), sc.CRITERIA_NAMES))
    s = of('x {"accuracy": 4, "reasoning": "2", "explanation": "none"} {"accuracy": 1}')
    assert (s.accuracy, s.reasoning, s.explanation, s.average) == (4.0, 2.0, 0.0, 3.0)
    s = of("1. Độ chính xác: 4/5\n2. Suy luận - 3 / 5\nTrung bình: 3.5/5")
    assert (s.accuracy, s.reasoning, s.completeness, s.average) == (4.0, 3.0, 0.0, 3.5)
    assert of("no scores").average == 0.0 and of(None) is None
    five = one(spark, sc.judge_scores(F.lit("Logical flow: 5/5\nClarity: 3/5"), sc.FIVE_CRITERIA_NAMES))
    assert (five.logical_flow, five.clarity, five.average) == (5.0, 3.0, 4.0)
    assert one(spark, sc.judge_explanation(F.lit("Giải thích: vì sai\n1 x"))) == "vì sai" and one(spark, sc.judge_explanation(F.lit('{"explanation": "e"}'))) == "e"
    second = one(spark, sc.second_judge(F.lit("Reasoning_Quality: 8\nCorrectness: 9.5\nFeedback: tốt: rõ\nhết")))
    assert (second.quality, second.correctness, second.feedback) == (0.8, 0.95, "tốt: rõ\nhết")
    assert one(spark, sc.second_judge(F.lit("?"))).quality is None
    x = one(spark, sc.error_analysis(F.lit("Loại lỗi: tính toán\nGiải thích: cộng sai")))
    assert (x.error_type, x.explanation) == ("Calculation Error", "cộng sai") and one(spark, sc.error_analysis(F.lit("?"))).error_type == "Unknown"
    assert one(spark, sc.error_class(F.lit("lỗi logical"))) == "Reasoning Error"


def test_tags_stand_alone(spark):
    of = lambda t: one(spark, tx.tags(F.lit(t)))
    assert of("Tính thể tích hình cầu") == ["hình học", "số học"] and of("sốc") == ["tổng hợp"] and of("còn dư,") == ["số học"]
    assert of("mấytuổimấy") == ["tuổi"] and of(None) == ["tổng hợp"] and "chuyển động" in of("đi 5 km/h")
    assert one(spark, tx.short_tags(F.lit("Con gà năm tuổi"))) == ["thực tế"] and one(spark, tx.short_tags(F.lit("con vịt"), True)) == ["thực tế"] and one(spark, tx.short_tags(F.lit("x"))) == []
    assert one(spark, tx.length_difficulty(F.lit("a b"), F.lit("1 2 3 4"))) == "Trung bình" and one(spark, tx.length_difficulty(F.lit("a"), F.lit("1 2 3"))) == "Khó"
    assert one(spark, tx.normalize_extracted(F.lit("a ,b  ( c )\n."))) == "a, b(c)."
