"""Generated question corpora: a weighted choice of families, templates filled with numbers, the same in every run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Family:
    """A family of questions: its weight, the ranges of its numbers, its texts with `{name}` for a number, the answer, and which draws are valid."""

    name: str
    weight: float
    numbers: dict[str, tuple[int, int]]
    question: str
    solution: str
    #: Columns of derived numbers by name, from the drawn ones.
    derived: dict[str, object]
    valid: object = None


FAMILIES = (
    Family("số học", 3, {"a": (10, 999), "b": (10, 999)}, "Tính tổng của {a} và {b}.", "{a} + {b} = {c}", {"c": lambda n: n["a"] + n["b"]}),
    Family("chia đều", 2, {"a": (20, 500), "b": (2, 12)}, "Có {a} quả cam chia đều cho {b} bạn. Mỗi bạn được mấy quả và còn dư mấy quả?", "Mỗi bạn được {q} quả, dư {r} quả.",
           {"q": lambda n: F.floor(n["a"] / n["b"]), "r": lambda n: n["a"] % n["b"]}, lambda n: n["a"] > n["b"]),
    Family("hình học", 2, {"a": (5, 99), "b": (2, 60)}, "Hình chữ nhật dài {a} m, rộng {b} m. Tính chu vi và diện tích.", "Chu vi: {p} m; diện tích: {s} m².",
           {"p": lambda n: 2 * (n["a"] + n["b"]), "s": lambda n: n["a"] * n["b"]}, lambda n: n["a"] > n["b"]),
    Family("chuyển động", 1, {"v": (20, 90), "t": (1, 9)}, "Xe đi với vận tốc {v} km/h trong {t} giờ. Tính quãng đường.", "{v} × {t} = {d} km", {"d": lambda n: n["v"] * n["t"]}),
    Family("josephus", 1, {"n": (3, 30), "k": (2, 7)}, "{n} người đứng thành vòng, cứ đếm đến người thứ {k} thì người đó ra. Ai ở lại?", "Người thứ {w}", {"w": lambda n: survivor(n["n"], n["k"])}),
)


def survivor(n: Column, k: Column) -> Column:
    """Who of n in a circle is left if every k-th goes, counted from 1."""
    return F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), F.lit(0), lambda at, m: F.when(m <= n, (at + k) % m).otherwise(at)).cast("bigint") + 1


def _draw(what: str, low: int, high: int, seed: int, tries: int) -> Column:
    """A whole number from a hash of seed, row and name: no generator's state, so any task gives the same."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.lit(tries), "id"), F.lit(high - low + 1)) + low).cast("int")


def _filled(text: str, numbers: dict[str, Column]) -> Column:
    out = F.lit(text)
    for name, value in numbers.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def generate(spark: SparkSession, n: int, families: Sequence[Family] = FAMILIES, seed: int = 42) -> DataFrame:
    """About n questions: id, question_type, question, solution, difficulty, in the order of a hash; draws that aren't valid are left out.

    Ids are those of the rows, so that parts of a corpus can be made apart.
    """
    from scoreloom.functions.text import difficulty

    total = sum(f.weight for f in families)
    pick = F.pmod(F.xxhash64(F.lit(seed), F.lit("family"), "id"), F.lit(1_000_000)) / 1_000_000.0
    made, below = None, 0.0
    for f in families:
        drawn = {k: _draw(f"{f.name}/{k}", *ends, seed, 0) for k, ends in f.numbers.items()}
        numbers = drawn | {k: make(drawn) for k, make in f.derived.items()}
        row = F.struct(F.lit(f.name).alias("question_type"), _filled(f.question, numbers).alias("question"), _filled(f.solution, numbers).alias("solution"))
        below += f.weight / total
        chosen = F.when(f.valid(drawn), row) if f.valid else row
        made = F.when(pick < below, chosen) if made is None else made.when(pick < below, chosen)
    out = spark.range(n).select("id", made.alias("q")).where(F.col("q").isNotNull())
    return out.select("id", "q.question_type", "q.question", "q.solution", difficulty(F.col("q.question"), F.col("q.solution")).alias("difficulty"))
