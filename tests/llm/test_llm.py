import random
import re
import unicodedata
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom.llm.endings import EndingModel, is_cut, open_delimiters
from scoreloom.llm.keyword_pages import PHRASE_COUNT, PHRASE_SHARE, PHRASE_WORDS, _repeats, _sequence, keyword_pages, keyword_share, segments
from scoreloom.llm.languages import language
from scoreloom.llm import leaks
from scoreloom.llm.leaks import ItemIndex, find_leaks, occurs
from scoreloom.llm.pairs import Question, defect_of, fit_endings, pair_defects
from scoreloom.llm.residue import is_idle, kind_of, latin_score, residue
from scoreloom.llm.suffix_automaton import SuffixAutomaton, covered
from scoreloom.llm.tokens import Encoder, encode_corpus, merge, read_ranks
from scoreloom.llm.top_items import top_n_per_group
from scoreloom.llm.truncation import at_limit, length_of, lengths, storage_limits

TOKENIZERS = "/opt/tokenizers"
NO_MODEL = EndingModel({}, frozenset())

# --- top items


def test_top_items_against_brute_force(spark):
    rng = random.Random(1)
    rows = [
        (rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([None, float("nan"), 1.0, 2.0, 3.0, -0.0, 0.0]), rng.choice([None, datetime(2022, 1, rng.randrange(1, 4))]))
        for i in range(600)
    ]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "g string, id bigint, s double, t timestamp").withColumn("__salt", F.lit("mine"))
    out = top_n_per_group(df, "g", "s", "id", 3, [F.col("t").asc_nulls_last()])
    assert out.columns == df.columns
    want = []
    for g in ("hot", "a", "b"):
        own = [r for r in rows if r[0] == g and r[2] is not None and r[2] == r[2]]
        want += sorted(own, key=lambda r: (-r[2], r[3] is None, r[3] or datetime(1, 1, 1), r[1]))[:3]
    assert sorted((r.g, r.id) for r in out.collect()) == sorted((r[0], r[1]) for r in want)


def test_top_items_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, id bigint, s double")
    assert top_n_per_group(df, "g", "s", "id", 5).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, "g", "s", "id", 0)


# --- token ids


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abc đệ\n\t 12\u00a0\u3000.,!'sét😀")), max_size=40) | st.text(max_size=30))
def test_ids_equal_the_public_encoder(text):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as public

    global _pair
    if "_pair" not in globals():
        table = read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
        _pair = Encoder(table), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=table, special_tokens={})
    import numpy as np

    mine, other = _pair
    assert np.frombuffer(mine.encode(text), np.int32).tolist() == other.encode_ordinary(text)


def test_trie_equals_plain_merging_and_round_trips(ranks):
    e = Encoder(ranks)
    back = {i: b for b, i in ranks.items()}
    for word in [" nghiêng", "aaaaaaaab", "x" * 2000, "<|endoftext|>", "١٢٣", "é" * 50]:
        raw = word.encode()
        ids = e.trie.encode(raw)
        assert b"".join(back[i] for i in ids) == raw
        if len(raw) < 300:
            assert ids == merge(raw, ranks)


def test_corpus_ids_of_null_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi"), (3, "hi"), (None, " ")], "doc_id bigint, text string").withColumn("ids", F.lit("mine"))
    out = encode_corpus(df, "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    assert sorted((r.doc_id or 0, r.ids) for r in out.collect()) == [(0, [220]), (1, []), (2, []), (3, [5303]), (3, [5303])]
    assert encode_corpus(df.limit(0), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken").count() == 0


# --- leaks


def words(text):
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", plain.replace("đ", "d"))


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["Đường", "nước", "một", "hai", "3", "x", "Ngõ", "cảnh", "sông", "ab_c", "núi", "và"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(5, 40))) for i in range(20)] + [(20, None), (21, ""), (22, "một hai ba")]
    docs = [(1000 + i, text(30)) for i in range(20)] + [(2000, None), (2001, ""), (2002, " \n")]
    for i in range(60):
        w = (items[rng.randrange(20)][1]).split()
        a = rng.randrange(len(w))
        part = w[a : a + rng.randrange(1, 20)]
        dirty = rng.choice([" ", "\n", " - ", "\u200b \u00a0"]).join(part)
        dirty = rng.choice([dirty, dirty.upper(), unicodedata.normalize("NFD", dirty), "".join(c for c in unicodedata.normalize("NFD", dirty) if not unicodedata.combining(c))])
        docs.append((3000 + i, f"{text(rng.randrange(5))} {dirty} {text(rng.randrange(5))}"))
    docs.append((4000, ("lorem " * 50_000) + items[0][1] * 2))
    grams = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in docs:
        w = words(t or "")
        for k in range(len(w) - 11):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, text string")
    assert want and {tuple(r) for r in find_leaks(d, i, "doc_id", "text", "item_id", "text").collect()} == want
    blocks = find_leaks(d, i, "doc_id", "text", "item_id", "text", block_chars=200)
    assert {tuple(r) for r in blocks.collect()} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", "-", "đường", "x" * 30]), max_size=60), st.integers(1, 60))
def test_pieces_cut_no_run_of_words(parts, size):
    text = " ".join(parts)
    pieces = list(leaks._pieces(text, size, 3))
    runs = lambda t: {tuple(w[k : k + 3]) for w in [words(t)] for k in range(len(w) - 2)}
    assert set().union(*map(runs, pieces)) == runs(text) and all(p in text for p in pieces)


def test_leaks_with_edits(spark):
    item = "trong le hoi den troi chi nuoi ong o deo ngo gio phoi kin mai hien"
    d = spark.createDataFrame([(1, "x " + item.replace("nuoi", "nuoj") + " y"), (2, item.replace("nuoi", "nuojx").replace("kin", "kjm"))], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert find_leaks(d, i, "doc_id", "text", "item_id", "text", min_words=15).count() == 0
    assert [tuple(r) for r in find_leaks(d, i, "doc_id", "text", "item_id", "text", min_words=15, edits=1).collect()] == [(1, 7)]
    assert find_leaks(d, i.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert find_leaks(d.limit(0), i, "doc_id", "text", "item_id", "text").count() == 0


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_leaks_keep_the_types_of_ids(spark, kind):
    text = " ".join(f"w{k}" for k in range(20))
    d = spark.createDataFrame([("5", text)], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    i = spark.createDataFrame([("7", text)], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
    out = find_leaks(d, i, "doc_id", "text", "item_id", "text")
    assert dict(out.dtypes) == {"doc_id": kind, "item_id": kind} and out.count() == 1 and str(out.first().item_id) == "7"


def edits_to_find(want, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(want):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_banded_alignment():
    rng = random.Random(6)
    for _ in range(400):
        want, text = ([rng.choice("abc") for _ in range(rng.randrange(low, 12))] for low in (1, 0))
        least = edits_to_find(want, text)
        assert all(occurs([*map(ord, want)], [*map(ord, text)], e) == (least <= e) for e in range(5))


@pytest.mark.parametrize("edits", [1, 3])
def test_leaks_with_edits_against_brute_force(edits, monkeypatch):
    monkeypatch.setattr(leaks, "PART", 500)
    rng = random.Random(edits)
    word = lambda: "".join(rng.choice("aeionbcdlm") for _ in range(rng.randrange(3, 8)))
    items = [" ".join(word() for _ in range(rng.randrange(12, 22))) for _ in range(8)]
    docs = []
    for _ in range(60):
        w = rng.choice(items).split()
        a = rng.randrange(len(w) - 8)
        part = list(" ".join(w[a : a + rng.randrange(9, 16)]))
        for _ in range(rng.randrange(0, 2 * edits + 2)):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([[], ["x"], [part[k], "y"]])
        docs.append(" ".join([word(), word(), "".join(part), word(), word()]))
    docs += [items[0] + " " + items[0], "", "a"]
    index = ItemIndex(list(range(8)), items, 12, edits)
    codes, marks = leaks.plain_codes(docs)
    plain = [" ".join(words(t)) for t in docs]
    want = set()
    for i, t in enumerate(items):
        w = words(t)
        for k in range(len(w) - 11):
            want |= {(d, i) for d, p in enumerate(plain) if edits_to_find(" ".join(w[k : k + 12]), p) <= edits}
    assert want and index.found(codes, marks) == want


def test_a_phrase_that_thousands_of_items_share():
    import tracemalloc

    opening = "trong bài toán sau đây em hãy đọc kỹ đề rồi trả lời đầy đủ"
    items = [f"{opening} câu số {k} gồm {k * 7} phần" for k in range(3000)]
    index = ItemIndex(list(range(3000)), items, 12, 0)
    tracemalloc.start()
    codes, marks = leaks.plain_codes([(opening + " x ") * 100, opening, "em hãy đọc"])
    found = index.found(codes, marks)
    assert tracemalloc.get_traced_memory()[1] < 700e6
    tracemalloc.stop()
    assert found == {(d, i) for d in (0, 1) for i in range(3000)}


# --- suffix automaton


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=10))
def test_automaton_against_brute_force(seq, other):
    a = SuffixAutomaton(seq)
    has = lambda part, whole: sum(whole[i : i + len(part)] == part for i in range(len(whole) - len(part) + 1))
    for i, n in enumerate(a.repeats()):
        assert n == max((k for k in range(1, i + 2) if has(seq[i + 1 - k : i + 1], seq) > 1), default=0)
    for i, n in enumerate(a.matches(other)):
        assert n == max((k for k in range(1, i + 2) if has(other[i + 1 - k : i + 1], seq)), default=0)
    counts = a.counts()
    for i, v in enumerate(a.ends):
        assert counts[v] == has(seq[: i + 1], seq)


def test_covered():
    assert covered([0, 1, 2, 0, 2], 2) == [False, True, True, True, True]
    assert covered([], 1) == []


# --- residue


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Đáp số: {{ answer }}", "placeholder"), ("là ${dap_so} đồng", "placeholder"), ("[điền lời giải vào đây]", "placeholder"), ("[Giải thích ngắn gọn về lỗi]", "placeholder"),
        ("__STEP_1__", "placeholder"), ("%(name)s", "placeholder"), ("<lý do ở đây>", "placeholder"), ("{so_luong}", "placeholder"),
        ("{{ " + "the final answer with its unit " * 3 + "}}", "placeholder"), ("[insert " + "one more step " * 6 + "here]", "placeholder"), ("<viết " + "từng bước giải " * 6 + "ở đây>", "placeholder"),
        ("[Your answer here]", "placeholder"), ("[Insert the solution]", "placeholder"), ("<Insert the solution>", "placeholder"), ("<YOUR ANSWER HERE>", "placeholder"), ("{{ a\nb }}", None),
        ("rutila viverum elitam quistam sedum", "filler"), ("nisi aliquip commodo consequat duis", "filler"), ("bar baz qux", "filler"), ("test\nabc\ntest\nabc\nxyz", "filler"), ("foo1bar_baz", "filler"),
        ("testing fools based on bars, abcd", None), ("Lorem ipsum dolor sit amet", "filler"), ("xxx test test abc", "filler"), ("Nội dung đang được biên soạn.", "filler"), ("Noi dung dang duoc bien soan.", "filler"),
        ("502 Bad Gateway", "error"), ('{"error": {"code": 400}}', "error"), ("Traceback (most recent call last):\n x", "error"), ("Đã xảy ra lỗi hệ thống.", "error"),
        ("You need to enable JavaScript to run this app.", "script"), ("Trang này yêu cầu bật script.", "script"),
        ("Phương trình {x + 3 = 5} viết đúng nhưng giải sai.", None), ("Tập hợp {1; 2; 3} và \\frac{a}{b}, \\boxed{12}", None), ("Error in step 3: the product should be 6.", None),
        ("Not an answer to the question; it only lists the numbers 1 and 2.", None), ("Lỗi tính toán: cộng sai ở bước 2.", None), ("\\[ 12 \\] Tổng", None), ("a < b và c > d", None), ("", None), (None, None),
    ],
)
def test_residue_kinds(text, kind):
    found = kind_of(text)
    assert (found and found[0]) == kind
    assert not found or 0 < found[1] <= 1.5


def test_filler_is_told_by_a_model_of_letters():
    unseen = "vestibulum ante ipsum primis faucibus orci luctus ultrices posuere cubilia curae donec velitum".split()
    assert sum(latin_score(w) or 0 for w in unseen) / len(unseen) > 1
    for text in ("Primero sumamos manzanas rojas verdes amarillas naranjas", "zuerst berechnen wir gesamte anzahl kleiner bunter steine", "perhatikan jumlah bilangan tersebut kemudian bagikan", "tong dien tich hinh vuong canh sau met"):
        assert kind_of(text) is None, text
    assert all(map(is_idle, "foo asdf lkj qwe aaa xyz test".replace("lkj", "jkl").split())) and not any(map(is_idle, "as mot hai total asdfx".split()))
    assert kind_of("Bước 1: xét đề bài. " + " ".join(unseen))[0] == "filler"


def test_patterns_that_share_an_opening_mark():
    assert kind_of("{{a}} {%b%}")[0] == "placeholder" and kind_of("tập {x} và \\frac{answer}{value}") is None
    assert kind_of("giá trị {answer}")[0] == "placeholder" and kind_of("x_{answer}") is None
    assert kind_of("HTTP/1.1 503")[0] == "error" and kind_of("http 4 trang, bài 404 not foundation") is None
    assert kind_of("Bài 404 - Not Found")[0] == "error" and kind_of("Trong 1404 not found này có bao nhiêu quả táo và bao nhiêu quả cam?") is None
    assert kind_of("error: bước 2 sai, đáp số 450 đúng ra là 405") is not None and kind_of("Lỗi ở bước 2, đáp số là 450") is None


def test_residue_rows(spark):
    rows = [(1, "TODO: viết lời giải ở đây", None), (2, None, "502 Bad Gateway"), (2, None, "502 Bad Gateway"), (3, "", "x" * 200_000)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string").withColumn("kind", F.lit("mine"))
    assert sorted((r.result_id, r.text_field) for r in residue(df, "id", ["a", "b"]).collect()) == [(1, "a"), (2, "b"), (2, "b")]
    assert residue(df.limit(0), "id", ["a", "b"]).count() == 0


# --- pairs and endings

QUESTION = "Mai có 133 viên bi, đem tặng 3/7 số đó. Hỏi Mai còn lại mấy viên bi?"


@pytest.mark.parametrize(
    ("text", "defect"),
    [
        (None, "empty"), ("** … **", "empty"), ("\u200b", "empty"), ("Xin lỗi, tôi không thể trả lời câu hỏi này.", "refusal"), ("I must decline this request.", "refusal"), ("抱歉，我无法回答。", "refusal"),
        ("Xin lỗi vì câu trả lời trước, mình tính lại: 133 - 57 = 76.", None), ("Không thể chia đều 7 viên bi cho 2 bạn, mỗi bạn được 3 viên.", None),
        (QUESTION.upper(), "copy"), ("Đề bài: " + QUESTION + "\n\nLời giải:", "copy"), (QUESTION + " " + QUESTION, "copy"), (QUESTION + " Đáp số: 76", None),
        ("Primero sumamos 18 y 53 para obtener 71. Luego hay que tener en cuenta el número 8.", "other_language"), ("The answer is that he has 76 marbles left over.", "other_language"),
        ("Vay con lai 76 vien bi.", None), ("76", None), ("= 76", None), ("Số viên bi ứng với 3/7 là 133 × 3 :", "truncated"), ("Ta có: Số viên bi được cho là (3 +", "truncated"),
    ],
)
def test_defects(text, defect):
    assert defect_of(QUESTION, text, NO_MODEL) == defect


def test_no_question_has_no_copy_and_no_language():
    assert defect_of(None, QUESTION, NO_MODEL) is None
    assert defect_of(" ", "The answer is that he has 76 marbles left.", NO_MODEL) is None


def test_quoted_question_does_not_hide_an_answer_without_blanks():
    asked = "Hỏi lớp học có tất cả bao nhiêu quyển vở được chia cho những bạn còn lại như trên?"
    quoted = "Trong bài này người ta hỏi số quyển vở mà những bạn được chia đều như vậy còn thừa"
    model = EndingModel.fit(["Bước một. Bước hai."])
    for rest in ("我们先把题目里给出的条件列出来然后再计算" * 20 + "。", "まずはじめにあたえられたかずをならべてけいさんします" * 20 + "。", "เราเริ่มจากข้อมูลที่โจทย์ให้มาแล้วคำนวณ" * 20):
        assert defect_of(asked, f"{quoted}\n{rest}", model) == "other_language"


def test_language_votes():
    assert language("Mot nguoi mua hai cai but va mot quyen vo, hoi con lai bao nhieu tien")[0] == "vi"
    assert language("Diketahui dua bilangan yaitu 60 dan 67, jumlahnya 127.")[0] == "id"
    assert language("12 + 3 = 15")[0] == ""


def solved(i):
    unit = ["viên bi", "quả táo", "cây bút"][i % 3]
    name = ["Mai", "Huy", "Lan"][i % 3]
    return f"{name} gom {i} {unit}.\nSố {unit} ứng với 1/2 là {2 * i} : 2 = {i} {unit}.\nTa so sánh kết quả với giới hạn mà đề bài đặt ra.\nKết luận: {name} còn lại {i} {unit}."


def test_endings_learned_from_texts():
    model = EndingModel.fit(solved(i) for i in range(120))
    rng, missed, wrong = random.Random(3), 0, 0
    for i in range(200, 300):
        t = solved(i)
        wrong += is_cut(t, model) + is_cut(t[:-1], model) + is_cut(t + "\n\n---", model) + is_cut(t + "\n\nx ≈ 3,33333...", model)
        cut = t[: rng.randrange(8, len(t) - 12)].rstrip()
        if cut[-1] != ".":
            missed += (not is_cut(cut, model)) + (not is_cut(cut + "...", model)) + (not is_cut(cut + " [...]", model))
    assert wrong == 0 and missed <= 6


def test_pair_rows(spark):
    rows = [(1, QUESTION, None, "76"), (2, QUESTION, "TODO: viết lời giải ở đây", ""), (2, QUESTION, "TODO: viết lời giải ở đây", ""), (3, None, "x" * 100_000, QUESTION)]
    df = spark.createDataFrame(rows, "id bigint, q string, a string, b string").withColumn("defect", F.lit(1)).withColumn("src", F.lit("s"))
    out = pair_defects(df, "id", "q", ["a", "b"], "a", "src")
    assert sorted((r.result_id, r.pair_field, r.defect) for r in out.collect() if r.result_id < 3) == [(1, "a", "empty"), (2, "b", "empty"), (2, "b", "empty")]
    assert pair_defects(df.limit(0), "id", "q", ["a", "b"], "a", "src").count() == 0


def test_lengths_agree_and_limits_show(spark):
    texts = ["", "a\nb", 'quote " & <x>', "đồng\r\n", "😀\\t"]
    row = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *(c.alias(k) for k, c in lengths(F.col("t")).items())).collect()
    for r in row:
        assert {k: int(r[k]) for k in lengths(F.col("t"))} == {k: length_of(k, r.t) for k in lengths(F.col("t"))}
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdeđ \n\"&") for _ in range(n)) + "z"
    cuts = {"cut ": lambda t: t[:200], "bytes": lambda t: t.encode()[:300].decode("utf-8", "ignore"), "json": lambda t: next(t[:k] for k in range(len(t), 0, -1) if length_of("json", t[:k]) <= 250), "free": lambda t: t}
    rows = [(s.upper() if k % 2 else s, cut(word(rng.randrange(60, 500)))) for s, cut in cuts.items() for k in range(400)]
    rows += [("template", f"Lỗi máy chủ, mã yêu cầu {1000 + k}, hãy thử lại sau ít phút nữa nhé, nút {100 + k}") for k in range(400)] + [("same", "x" * 99)] * 400 + [(None, None)]
    found = storage_limits(spark.createDataFrame(rows, "s string, t string"), "s", "t").collect()
    assert {(r.source, r.measure) for r in found} == {("cut", "characters"), ("bytes", "utf8"), ("json", "json")} and len(found) == 3
    assert {r["size"] for r in found} - {200, 250} <= {298, 299, 300}
    assert storage_limits(spark.createDataFrame([], "s string, t string"), "s", "t").count() == 0


def test_a_limit_decides_before_the_ending():
    model = EndingModel.fit(solved(i) for i in range(120))
    at = lambda t: at_limit([("characters", len(t))], t)
    # Sentences that often end after the first word of a unit, so that the ending alone can't tell.
    model = EndingModel.fit([*map(solved, range(120)), *(f"Có {i} quả. Còn {i} quả." for i in range(100)), *(f"Có {i} quả táo đỏ." for i in range(40))])
    text = "Bạn Mai nói rằng: Còn 15 quả"
    assert not is_cut(text, model) and is_cut(text, model, limited=at) and not is_cut(text, model, limited=lambda t: False)
    assert is_cut(text + "...", model, limited=at) and is_cut(text + " ...", model, limited=lambda t: t.endswith("quả"))
    assert not is_cut(solved(300), model, limited=at) and not is_cut(solved(300), model, limited=lambda t: True)


def test_delimiters_are_a_stack():
    for text in ("ta có (3 + 4", "tập [0; 5", "**Bước", "\\[ 12 + 3", "```x", "\\frac{1}{2", "(a [b) c [d", "$$ x"):
        assert open_delimiters(text), text
    for text in ("a) và b)", "[0; 5) và (1; 2]", "**đậm** (x)", "\\[ 12 \\]", "([{}])", ""):
        assert not open_delimiters(text), text
    model = EndingModel.fit(solved(i) for i in range(120))
    done = solved(300)[:-1]
    assert not is_cut(done, model) and is_cut(done.replace("Kết luận: ", "Kết luận: ("), model)


def test_a_copy_keeps_the_order_of_words():
    q = Question(QUESTION)
    words = QUESTION.rstrip("?").split()
    moved = [*words[6:], *words[:6]]
    assert q.is_copied_by(" ".join(moved)) and q.is_copied_by(" ".join(w for k, w in enumerate(words) if k != 8))
    rng, copies = random.Random(4), 0
    for _ in range(50):
        rng.shuffle(words)
        copies += q.is_copied_by(" ".join(words))
    assert copies == 0
    assert not q.is_copied_by(" ".join(words[:3])) and not q.is_copied_by(QUESTION + " xong rồi nhé các bạn ơi ta được đáp án cuối cùng như thế này đây")


def test_sample_is_chosen_by_id(spark):
    df = spark.range(40_000).select("id", F.lit("Một câu giống nhau. Hết.").alias("t"))
    model = fit_endings(df, "id", ["t"], 500)
    assert model.known == {} or max(n for _, n, _ in model.known.values()) <= 2  # one text, however many copies are drawn
    assert fit_endings(df.limit(0), "id", ["t"]).known == {}


def test_endings_are_learned_from_every_row(spark):
    rows = [(i, f"Mua {i} g đường.\nCòn {i} g.", None if i % 3 else f"Lời {i}.\nĐáp số: {i} g") for i in range(9_000)]
    df = spark.createDataFrame([*rows, *rows[:50], (0, "", None)], "id bigint, t string, u string")
    model, whole = fit_endings(df, "id", ["t", "u"]), EndingModel.fit(t for r in rows for t in r[1:] if t)
    assert model.known == whole.known and model.last_lines == whole.last_lines == {"dap so : 0 g"}
    assert model.known["duong "] == (9_000, 9_000, 0) and model.known["con "][1] == 9_000


def test_rare_endings_of_a_large_table_are_known(spark):
    words = "thỏ vịt ngan dê bò trâu cừu lạc hổ voi gấu khỉ".split()
    rows = [f"Mua {i} g đường.\nCòn {i} g." for i in range(9_000)] + [f"Nhà có {i} con {w}." for w in words for i in range(4)]
    rows += [f"Nhà có 77 con {w}" for w in words] + ["Nhà có 77 con kh", "Nhà có 77 con"]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(rows)], "id bigint, q string, a string")
    out = pair_defects(df, "id", "q", ["a"], only=("a", "truncated"))
    assert sorted(rows[r.result_id] for r in out.collect()) == ["Nhà có 77 con", "Nhà có 77 con kh"]


def test_many_cuts_at_one_place_are_no_ending():
    finished = [f"Lấy {i} g bột.\nTa biểu diễn quan hệ giữa các số bằng sơ đồ." for i in range(300)]
    cuts = [f"Lấy {i} g bột.\nTa biểu diễn quan hệ g" for i in range(300, 330)]
    dotted = [f"Lấy {i} g bột.\nTa biểu diễn qua" + dots for i in range(330, 360) for dots in ("...", "…", " [...]")]
    remarks = [f"Lấy {i} g bột.\nChúc em học tốt" for i in range(360, 390)]
    model = EndingModel.fit([*finished, *cuts, *dotted, *remarks, *map(str, range(30)), "Đi qua sông. Ta qua cầu. Em qua đò. Anh qua phà. Tốt lắm. Tốt quá. Tốt hơn. Tốt nhất."])
    assert all(is_cut(t, model) for t in (*cuts, *dotted)) and not any(is_cut(t, model) for t in (*finished, *remarks, "76"))


# --- keyword pages

TEXT = "Giáo viên bộ môn ghi lại từng bước về phân số trong tuần đầu tiên. Hãy thử thay 85 bằng 96 và xem kết quả đổi thế nào. "


@pytest.mark.parametrize(
    ("text", "spam"),
    [
        ("\n".join(f"gia sư toán quận {q} giá rẻ" for q in "ABCDEFGH" * 3), True), (", ".join(["học toán online", "giải toán lớp 5"] * 12), True), ("#hocToan #giaiToan12 #deThi " * 10, True),
        ("\n".join(f"https://m{i}.example/tag/{i}.html" for i in range(20)), True), ("\n".join(["Trang chủ > Học toán > Đề thi > Vở ô ly"] * 8), True),
        ("\n".join(f"bút chì A{i} - mã SP{i}123 - {i}2.000đ - còn hàng" for i in range(1, 9)), True), ("Ai cần vở ô ly hãy xem vở ô ly tại đây. vở ô ly có ngay vở ô ly. " * 8, True),
        (TEXT * 5, False), ("\n".join(f"7 × {i} = {7 * i}" for i in range(1, 11)), False), ("Đáp án: " + " ".join(f"{i}.A" for i in range(1, 40)), False),
        (TEXT * 4 + "Tham khảo:\n[1] http://a.example/1\n[2] http://b.example/2", False), (TEXT * 3 + "Từ khóa: phân số, tỷ lệ, vận tốc", False), ("", False), (" \n", False), ("một", False),
    ],
)
def test_keyword_share(text, spam):
    assert (keyword_share(text) > 0.5) == spam


def test_repeats_and_phrases_against_brute_force():
    rng = random.Random(8)
    lines = ["bút chì giá rẻ", "bút chì A1 - mã SP1 - 12.000đ", "Trang chủ > Lớp 5 > Đề thi", "#hocToan #giaiToan", "https://a.example/tag/1", "em là học sinh của lớp và các bạn là bạn.", "gia sư toán", "vở ô ly", "phân số", "7 8 9"]
    for _ in range(150):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 30)))
        words, parts, glue = segments(text)
        symbols, place, ends = _sequence(words, parts)
        blocks, at = [], 0
        for e in sorted({*ends, len(symbols)}):
            blocks.append(range(at, e))
            at = e
        spots = {}
        for block in blocks:
            for i in block:
                for n in range(2, min(len(block), block.stop - i) + 1):
                    spots.setdefault(tuple(symbols[i : i + n]), []).append(i)
        twice, phrase = set(), set()
        for sub, found in spots.items():
            for i in found if len(found) > 1 else ():
                twice.update(range(i, i + len(sub)))
            if len(found) >= PHRASE_COUNT and len(found) * min(len(sub), PHRASE_WORDS) >= PHRASE_SHARE * len(words) and len(sub) <= PHRASE_WORDS:
                for i in found:
                    phrase.update(range(i, i + len(sub)))
        repeated, phrases = _repeats(words, parts, glue)
        loose = {i for s in parts if s.loose for i in range(s.at, s.at + s.size)}
        assert {i for i, x in enumerate(repeated) if x and i in loose} == {place[i] for i in twice if place[i] in loose}
        if any(phrases):
            assert {i for i, x in enumerate(phrases) if x} == {place[i] for i in phrase if place[i] >= 0}


def test_keyword_share_holds_at_any_threshold(spark):
    pages = [TEXT * 4 + "\n" + "\n".join(f"gia sư toán quận {q} giá rẻ" for q in "ABCDE"), TEXT * 2, "\n".join(["Trang chủ > Học toán > Đề thi > Vở ô ly"] * 3) + "\n" + TEXT * 5]
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id bigint, text string")
    shares = [keyword_share(t) for t in pages]
    assert 0.1 < shares[0] < 0.5 and shares[1] == 0 and 0.1 < shares[2] < 0.5
    for over in (0.05, 0.2, 0.5):
        assert {(r.doc_id, r.keyword_share) for r in keyword_pages(df, "doc_id", "text", over).collect()} == {(i, x) for i, x in enumerate(shares) if x > over}


def test_keyword_rows(spark):
    spam = ", ".join(["học toán online", "giải toán lớp 5"] * 12)
    df = spark.createDataFrame([(1, spam), (1, spam), (2, TEXT * 2000), (3, None), (4, "")], "doc_id bigint, text string").withColumn("keyword_share", F.lit(1))
    assert [r.doc_id for r in keyword_pages(df, "doc_id", "text").collect()] == [1, 1]
    assert keyword_pages(df.limit(0), "doc_id", "text").count() == 0
