"""Defects of question-answer pairs: empty, refusal, copy, other_language, truncated."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.endings import SEEN, EndingModel, begun, context_counts, is_cut, sentence_counts, start_counts
from scoreloom.llm.languages import language, same_at_once
from scoreloom.llm.phrases import automaton, bare, spans
from scoreloom.llm.residue import kind_of
from scoreloom.llm.suffix_automaton import SuffixAutomaton, covered
from scoreloom.llm.truncation import at_limit, limit_map, source_key, storage_limits
from scoreloom.session import spread, written

#: Contexts that a worker adds up before it passes them on.
HELD = 200_000

#: Phrases of refusals.
REFUSAL = """
không thể trả lời|không trả lời được|không thể giúp|không giúp được|không giúp bạn được|không hỗ trợ dạng|không hỗ trợ loại
không thể hỗ trợ|không thể giải|không giải được|không thể thực hiện yêu cầu|từ chối thực hiện|từ chối trả lời|xin từ chối
từ chối yêu cầu|ngoài phạm vi hỗ trợ|ngoài phạm vi|xin phép không|không có thông tin để|không có đủ thông tin|không đủ thông tin
đành bỏ qua|chịu thua|không được phép|không đưa ra được|không đưa ra lời giải|không đưa ra đáp án|không thể đưa ra
chưa đủ khả năng|không đủ khả năng|không có khả năng giải|không có khả năng trả lời|chưa thể trả lời|chưa thể giải
chưa được huấn luyện để giải|không làm được bài|không tìm ra lời giải|không nằm trong khả năng|vượt quá khả năng
không thể cung cấp|không tiện trả lời|không biết câu trả lời|tôi không biết|mình không biết|không thể xử lý|không thể tiếp tục
can't help|cannot help|can not help|can't answer|cannot answer|not able to answer|unable to answer|not able to help
unable to help|unable to assist|can't assist|cannot assist|can't provide|cannot provide|unable to provide|can't solve
cannot solve|unable to solve|must decline|have to decline|i decline|falls outside what i can|outside what i can do
outside my scope|beyond my abilities|won't be providing|will not be providing|won't provide|don't feel able
do not feel able|something i cannot do|something i can't do|not something i can|i don't know the answer|can't comply
cannot comply|can't do that|not allowed to|can't complete this|cannot fulfill|can't fulfill|against my guidelines
no puedo ayudar|no puedo responder|no puedo resolver|no me es posible|no estoy en condiciones|me niego
je ne peux pas|je ne suis pas en mesure|il m'est impossible|je refuse|je dois refuser
ich kann nicht|ich kann diese|ich kann dir|ich kann ihnen nicht|kann ich nicht beantworten|nicht beantworten|nicht helfen|muss ich ablehnen
tidak bisa menjawab|tidak dapat menjawab|tidak bisa membantu|tidak dapat membantu|saya menolak|di luar kemampuan
não posso ajudar|não posso responder|non posso aiutar|non posso rispondere
не могу ответить|не могу помочь|не могу решить|не в состоянии|вынужден отказать
我无法|无法回答|无法提供|不能回答|无法帮助|我不能|拒绝回答
お答えできません|回答できません|お手伝いできません|できかねます|対応できません
답변할 수 없|도와드릴 수 없|답할 수 없|도움을 드릴 수 없
ไม่สามารถตอบ|ไม่สามารถช่วย|ไม่สามารถให้|ขอปฏิเสธ
""".replace("\n", "|").strip("|").split("|")
#: Signs that a text does give a solution: a computed result or a concluding phrase.
_SOLVED = re.compile(
    r"=\s*\(?[-+]?\d|≈\s*\d|\\boxed|(?:đáp số|kết luận|kết quả|đáp án|trả lời|answer|dap so|ket luan|ket qua|tra loi)\s*(?:là|la|is)?\s*[:=]?\**\s*[-+]?\d", re.I
)
_CONTENT = re.compile(r"[^\W_]")
_WORD = re.compile(r"[^\W_]+")
#: A copy has runs of so many words of the question, in its order, that hold at least this share
#: of the question, at most this many or this share of other words, and no number or equation of its own.
COPY_RUN, COPY_OF_QUESTION, COPY_OWN_WORDS, COPY_OWN_SHARE = 3, 0.6, 8, 0.25
#: Votes of common words, and their share, from which a text has a language.
LANGUAGE_VOTES, LANGUAGE_SHARE = 3.0, 0.55

_REFUSALS = None


def is_empty(text: str | None) -> bool:
    """Whether a text is null or holds no letter and no digit."""
    return text is None or not _CONTENT.search(text)


def is_refusal(text: str) -> bool:
    """Whether a text declines to answer and gives no solution."""
    global _REFUSALS
    if _REFUSALS is None:
        _REFUSALS = automaton({"refusal": REFUSAL})
    low = text.lower()
    if "’" in low:
        low = low.replace("’", "'")
    hits = spans(_REFUSALS, low).get("refusal")
    if not hits:
        # Scripts without blanks between words have no word boundaries.
        if low.isascii() or not any(last >= 0 and not low[last].isascii() and ord(low[last]) > 0x0E00 for last, _ in _REFUSALS.iter(low)):
            return False
    return not _SOLVED.search(re.sub(r'"[^"\n]*"', "", text))


class Question:
    """The words of a question, with their suffix automaton once it is needed."""

    __slots__ = ("automaton", "equation", "known", "language", "words")

    def __init__(self, text: str):
        self.words = _WORD.findall(bare(text))
        self.known = frozenset(self.words)
        self.equation = "=" in text
        self.automaton = None
        lang, n, share = language(text)
        self.language = lang if n >= LANGUAGE_VOTES and share >= LANGUAGE_SHARE else ""

    def is_copied_by(self, text: str) -> bool:
        """Whether a text says no more than the question.

        The text runs through the question's suffix automaton. Runs of at least
        COPY_RUN words that the question has in the same order must cover the text,
        but for a few words, and most of the question: the same words in another
        order are no copy.
        """
        if not self.words or ("=" in text and not self.equation):
            return False
        own = _WORD.findall(bare(text))
        allowed = max(COPY_OWN_WORDS, COPY_OWN_SHARE * len(own))
        if len(own) < COPY_OF_QUESTION * len(self.words):
            return False
        if self.automaton is None:
            self.automaton = SuffixAutomaton(self.words)
        runs: list[tuple[int, int]] = []
        unknown = 0
        for n, v in self.automaton.walk(own):
            if not n:
                unknown += 1
                if unknown > allowed:
                    return False
            runs.append((n, v))
        under = covered([n for n, _ in runs], COPY_RUN)
        if under.count(False) > allowed:
            return False
        held = [False] * len(self.words)
        for (n, v), (after, _) in zip(runs, [*runs[1:], (0, 0)]):
            if n >= COPY_RUN and after <= n:
                last = self.automaton.first[v]
                held[last + 1 - n : last + 1] = [True] * n
        if sum(held) < COPY_OF_QUESTION * len(held):
            return False
        # A number of its own is a result, unless it only labels the question.
        return not any(w.isdigit() and w not in self.known for w in own[under.index(True) :])


_QUESTIONS: dict[str, Question] = {}
_MAX_QUESTIONS = 20_000


def question(text: str) -> Question:
    """The question of a text, kept in a bounded cache of this worker."""
    q = _QUESTIONS.get(text)
    if q is None:
        if len(_QUESTIONS) >= _MAX_QUESTIONS:
            _QUESTIONS.clear()
        q = _QUESTIONS[text] = Question(text)
    return q


def defect_of(
    asked: str | None, text: str | None, model: EndingModel, whole: str | None = None, limited: Callable[[str], bool] | None = None
) -> str | None:
    """The first defect that fits, in the order of this module's first line, or None.

    `whole` is another wording of the result; `limited` tells whether a text is
    as long as a storage limit of its source.
    """
    if is_empty(text):
        return "empty"
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if is_refusal(text):
        return "refusal"
    if asked is not None and asked.strip():
        q = question(asked)
        if q.is_copied_by(text):
            return "copy"
        if q.language:
            if same_at_once(text, q.language):
                return "truncated" if is_cut(text, model, whole, limited) else None
            lang, n, share = language(text)
            if lang and lang != q.language and n >= LANGUAGE_VOTES and share >= LANGUAGE_SHARE:
                return "other_language"
    return "truncated" if is_cut(text, model, whole, limited) else None


def _sentences_of(batches: Iterable) -> Iterator:
    """Sentences of distinct texts with their counts, by batch."""
    import pyarrow as pa

    for batch in batches:
        rows = [(*s, n) for s, n in sentence_counts(batch.column(0).to_pylist()).items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.bool_(), pa.bool_(), pa.int64()))], ["s", "ended", "finished", "n"])


def _contexts_of(batches: Iterable) -> Iterator:
    """Contexts of distinct sentences with their counts, added up over many sentences."""
    import pyarrow as pa

    def out(counts: dict[str, list[int]]) -> pa.RecordBatch:
        columns = zip(*counts.values()) if counts else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["ctx", "seen", "ends", "lasts"])

    counts: dict[str, list[int]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            context_counts((row,), counts)
            if len(counts) >= HELD:
                yield out(counts)
                counts.clear()
    yield out(counts)


def fit_endings(df: DataFrame, id_col: str, text_cols: list[str], rows: int | None = None) -> EndingModel:
    """The model of sentence endings of all texts, each different text once.

    Stops and line breaks label sentences and lines. Whole texts are moved once, to
    tell different ones; what is counted is added up by the executors, and only the
    contexts and lines of the model itself come to the driver. An empty table gives
    an empty model, by which only texts that end inside a delimiter, or without a
    stop, are cut. `rows` asks for about so many rows instead, chosen by a hash of
    their id; no query does.
    """
    if rows is not None and (total := df.count()) > rows:
        # The first 60 bits of the hash, so that the share stays exact for any number of rows.
        df = df.where(F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`")), 4) < F.lit(int((1 << 60) * rows / total)))
    texts = df.select(F.explode(F.array(*(F.col(f"`{c}`") for c in text_cols))).alias("t")).where("t <> ''").distinct()
    found = texts.mapInArrow(_sentences_of, "s string, ended boolean, finished boolean, n bigint")
    sentences = written(found.groupBy("s", "ended", "finished").agg(F.sum("n").alias("n")))

    sums = [F.sum(c).alias(c) for c in ("seen", "ends", "lasts")]
    contexts = spread(sentences).mapInArrow(_contexts_of, "ctx string, seen bigint, ends bigint, lasts bigint").groupBy("ctx").agg(*sums)
    contexts = written(contexts.where(F.col("seen") >= SEEN))
    # A longer context is kept only where the shorter one is undecided.
    undecided = contexts.where("ends > 0 AND (ends < seen OR lasts NOT IN (0, ends))").select(F.col("ctx").alias("shorter"))
    shorter = F.expr("substring(ctx, instr(ctx, ' ') + 1)")
    kept = contexts.withColumn("shorter", shorter)
    kept = kept.where("shorter = ''").unionByName(kept.join(undecided, "shorter", "left_semi"))
    known = {r.ctx: (r.ends, r.seen, r.lasts) for r in kept.toLocalIterator()}

    finals = sentences.where("NOT ended").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= 2 * SEEN)
    lines = EndingModel.candidates((r.s for r in finals.toLocalIterator()), known)
    if not lines:
        return EndingModel(known, frozenset())
    looked_for = df.sparkSession.sparkContext.broadcast(lines | {begun(x) for x in lines})

    def starts_of(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            starts, whole = start_counts(rows, looked_for.value), Counter()
            for s, n in rows:
                if s in looked_for.value:
                    whole[s] += n
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.string()), pa.array(starts.values(), pa.int64()), pa.array([whole[x] for x in starts], pa.int64())], ["line", "starts", "whole"])

    counts = sentences.select("s", "n").mapInArrow(starts_of, "line string, starts bigint, whole bigint").groupBy("line").agg(F.sum("starts").alias("starts"), F.sum("whole").alias("whole"))
    found = {r.line: r for r in counts.toLocalIterator()}
    looked_for.destroy()
    return EndingModel(known, EndingModel.usual({x: found[x].whole for x in lines}, {x: r.starts for x, r in found.items()}))


def pair_defects(
    df: DataFrame,
    id_col: str,
    question_col: str,
    text_cols: list[str],
    residue_col: str | None = None,
    source_col: str | None = None,
    out_id: str = "result_id",
    only: tuple[str, str] | None = None,
) -> DataFrame:
    """One row (id, pair_field, defect) for each defective pair of the question with a text.

    Defects are `empty`, `refusal`, `copy`, `other_language` and `truncated`; the
    first that fits counts. A text of `residue_col` that is residue (placeholder,
    filler, error or script notice) has no defect. With `source_col`, the storage
    limits of each source in the first text column count as evidence of a cut.
    `only`, a (column, defect), keeps one kind of case.

    The endings are learned from all texts, which are moved once to tell different
    ones. The limits are one aggregation of counts; the pairs are one pass without a
    shuffle over whole texts. A null or blank question has no copy and no other
    language; null and blank texts are `empty`; a bare result is a valid answer;
    repeated rows come out each; an empty table gives no row.
    """
    spark = df.sparkSession
    first = text_cols[0]
    model = spark.sparkContext.broadcast(fit_endings(df, id_col, text_cols))
    names = [id_col, question_col, *text_cols]
    rows = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), *([source_key(F.col(f"`{source_col}`")).alias("source")] if source_col else []))
    by_source = None
    if source_col:
        limits = storage_limits(df, source_col, first)
        by_source = limit_map(limits)
        if by_source is None:
            listed = limits.groupBy("source").agg(F.collect_list(F.struct("measure", "size")).alias("limits"))
            rows = rows.join(listed, "source", "left").select(*(f"c{k}" for k in range(len(names))), "limits")
    kept = spark.sparkContext.broadcast(by_source)
    at_source = len(names) if source_col else None

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        endings, by_source = model.value, kept.value
        for batch in batches:
            asked = batch.column(1).to_pylist()
            texts = [batch.column(k).to_pylist() for k in range(2, 2 + len(text_cols))]
            sources = batch.column(at_source).to_pylist() if at_source else None
            at, field, defect = [], [], []
            for k, (name, column) in enumerate(zip(text_cols, texts)):
                if only and name != only[0]:
                    continue
                other = texts[1] if k == 0 and len(texts) > 1 else None
                for i, (q, t) in enumerate(zip(asked, column)):
                    limited = None
                    if k == 0 and sources is not None:
                        own = by_source.get(sources[i]) if by_source is not None else [(x["measure"], x["size"]) for x in sources[i] or ()]
                        if own:
                            limited = partial(at_limit, own)
                    d = defect_of(q, t, endings, other[i] if other else None, limited)
                    # Residue is looked for only where it would take a defect away.
                    if d and (only is None or d == only[1]) and not (name == residue_col and kind_of(t)):
                        at.append(i)
                        field.append(name)
                        defect.append(d)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(defect, pa.string())],
                [out_id, "pair_field", "defect"],
            )

    schema = T.StructType(
        [T.StructField(out_id, df.schema[id_col].dataType), T.StructField("pair_field", T.StringType()), T.StructField("defect", T.StringType())]
    )
    return spread(rows).mapInArrow(run, schema)
