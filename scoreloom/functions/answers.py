"""Whether a response gives the expected answer, by the kind of question. All are Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.numbers import fraction_equal, let, number_equal

_N = r"([0-9]+[.,]?[0-9]*)"
#: Patterns of the number that answers a question of each kind.
WORK = tuple(p.replace("N", _N) for p in (r"N\s*giờ", r"N\s*phút", r"N\s*giây", r"N\s*h", r"N\s*min", r"N\s*s", r"t\s*=\s*N", r"thời gian\s*=\s*N", r"thời gian là\s*N"))
CANDY = (r"([0-9]+)\s*viên", r"x\s*=\s*([0-9]+)", r"được\s*([0-9]+)\s*viên", r"mỗi\s*người\s*\w*\s*([0-9]+)", r"người\s*thứ\s*nhất\s*\w*\s*([0-9]+)")
MIXTURE = tuple(p.replace("N", _N) for p in (r"N\s*g", r"N\s*gram", r"x\s*=\s*N", r"cần thêm\s*N", r"phải thêm\s*N"))
NUMBER = (r"số cần tìm là:?\s*([0-9]+)", r"số cần tìm:?\s*([0-9]+)", r"kết quả là:?\s*([0-9]+)", r"vậy số là:?\s*([0-9]+)", r"số đó là:?\s*([0-9]+)", r"x\s*=\s*([0-9]+)")
AREA = tuple(p.replace("N", _N) for p in (r"diện tích:?\s*N", r"diện tích là:?\s*N", r"diện tích\s*=\s*N", r"N\s*cm²", r"N\s*m²"))
PERIMETER = tuple(p.replace("N", _N) for p in (r"chu vi:?\s*N", r"chu vi là:?\s*N", r"chu vi\s*=\s*N"))
MOTION = tuple(p.replace("N", _N) for p in (r"sau\s*N\s*giờ", r"t\s*=\s*N", r"thời gian\s*=\s*N", r"thời gian gặp nhau\s*=\s*N", r"thời gian là\s*N", r"gặp nhau sau\s*N"))
SHARE = (r"([0-9]+)\s*quả mỗi người", r"mỗi người được\s*([0-9]+)\s*quả", r"mỗi người\s*([0-9]+)\s*quả", r"chia được\s*([0-9]+)")
REMAINDER = (r"dư\s*([0-9]+)\s*quả", r"còn lại\s*([0-9]+)\s*quả", r"dư\s*([0-9]+)")
AGE = (r"([0-9]+)\s*năm", r"sau\s*([0-9]+)\s*năm", r"x\s*=\s*([0-9]+)")
POOL = tuple(p.replace("N", _N) for p in (r"N\s*giờ", r"thời gian cần:\s*N", r"sẽ đầy sau\s*N", r"thời gian:?\s*N", r"đầy sau\s*N"))
FRACTION = (r"tổng\s*=\s*([0-9]+/[0-9]+)", r"tích\s*=\s*([0-9]+/[0-9]+)", r"hiệu\s*=\s*([0-9]+/[0-9]+)", r"thương\s*=\s*([0-9]+/[0-9]+)")
MONEY = tuple(p.replace("N", _N) for p in (r"N\s*đ", r"N\s*đồng", r"N\s*vnd", r"số tiền:?\s*N", r"phải trả:?\s*N", r"giá tiền:?\s*N"))
#: What says that there is no such number, in the answer and in a response.
NO_NUMBER, SAYS_NO_NUMBER = ("không có số", "không tồn tại"), ("không có số", "không tồn tại", "không có")
#: Relative tolerance of numbers, of exact ones and of the pool's times.
TOLERANCE, CLOSE, POOL_TOLERANCE = 0.02, 0.01, 0.03


def has(c: Column, *parts: str) -> Column:
    """Whether one of the parts occurs."""
    out = F.contains(c, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(c, F.lit(p))
    return out


def answer_numbers(c: Column) -> Column:
    """All numbers of a text, a minus sign included, with comma or point as decimal mark."""
    found = F.regexp_extract_all(c, F.lit(r"-?[0-9]+[.,]?[0-9]*"), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.translate(t, ",", ".").try_cast("double")), lambda x: x.isNotNull())


def _found(c: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(c, pattern, F.lit(1))


def _any_pair(a: Column, b: Column, same: Callable[[Column, Column], Column]) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: same(x, y)))


def _some(patterns: Sequence[str], test: Callable[[Column], Column]) -> Column:
    """Whether some pattern passes. The patterns are one constant array: a branch for each would make plans of thousands of nodes."""
    return F.exists(F.array(*(F.lit(f"(?u){p}") for p in patterns)), test)


def by_patterns(r: Column, e: Column, patterns: Sequence[str], same: Callable[[Column, Column], Column]) -> Column:
    """Whether some pattern finds values in both texts that are the same."""
    return _some(patterns, lambda p: let(lambda a, b: _any_pair(a, b, same), _found(r, p), _found(e, p)))


def near(tolerance: float = TOLERANCE) -> Callable[[Column, Column], Column]:
    """Equality of two numbers as written, within a tolerance."""
    value = lambda t: F.translate(t, ",", ".").try_cast("double")
    return lambda x, y: F.coalesce(number_equal(value(x), value(y), tolerance), F.lit(False))


def same_text(x: Column, y: Column) -> Column:
    return x == y


def matched(given: Column, wanted: Column, tolerance: float = TOLERANCE) -> Column:
    """How many of the wanted numbers are among the given ones."""
    return F.size(F.filter(wanted, lambda b: F.exists(given, lambda a: number_equal(a, b, tolerance))))


def _last_of(given: Column, wanted: Column, tolerance: float) -> Column:
    """Whether the last wanted number, unless it is 0, is among the given ones."""
    last = F.try_element_at(wanted, F.lit(-1))
    return F.coalesce((last != 0) & F.exists(given, lambda a: number_equal(a, last, tolerance)), F.lit(False))


def money_value(t: Column) -> Column:
    """An amount as written without its separators."""
    return F.translate(t, ".,", "").try_cast("double")


def same_fraction(x: Column, y: Column) -> Column:
    part = lambda t, k: F.get(F.split(t, "/"), F.lit(k)).try_cast("bigint")
    return F.coalesce(fraction_equal(part(x, 0), part(x, 1), part(y, 0), part(y, 1)), x == y)


def _candy(r, e, nr, ne):
    # Without a number by a pattern in the answer, the numbers of either text count.
    def plain(p: Column) -> Column:
        own = let(lambda f: F.when(F.size(f) > 0, F.transform(f, lambda t: t.try_cast("double"))).otherwise(nr), _found(r, p))
        return (F.size(_found(e, p)) == 0) & let(lambda o: _any_pair(o, ne, lambda x, y: F.coalesce(number_equal(x, y, TOLERANCE), F.lit(False))), own)

    return by_patterns(r, e, CANDY, near()) | _some(CANDY, plain)


def _number(r, e, nr, ne):
    return F.when(has(e, *NO_NUMBER), has(r, *SAYS_NO_NUMBER)).otherwise(by_patterns(r, e, NUMBER, same_text) | _last_of(nr, ne, CLOSE))


def _geometry(r, e, nr, ne):
    area, around = by_patterns(r, e, AREA, near()), by_patterns(r, e, PERIMETER, near())
    both = has(e, "diện tích và chu vi")
    return F.when(both, area & around).otherwise(area | around | ((F.size(ne) >= 2) & (matched(nr, ne) >= 2)))


def _shares(r, e, nr, ne):
    both = by_patterns(r, e, SHARE, same_text) & by_patterns(r, e, REMAINDER, same_text)
    return both | (matched(nr, ne, CLOSE) >= 2)


def _pool(r, e, nr, ne):
    same = lambda x, y: number_equal(x, y, POOL_TOLERANCE)
    return by_patterns(r, e, POOL, near(POOL_TOLERANCE)) | _any_pair(nr, ne, same)


def _fraction(r, e, nr, ne):
    halves = lambda a, b: (F.size(b) > 0) & (2 * F.size(F.filter(b, lambda y: F.exists(a, lambda x: same_fraction(x, y)))) >= F.size(b))
    return by_patterns(r, e, FRACTION, same_fraction) | let(halves, _found(r, F.lit("([0-9]+/[0-9]+)")), _found(e, F.lit("([0-9]+/[0-9]+)")))


def _money(r, e, nr, ne):
    same = lambda x, y: F.coalesce(number_equal(money_value(x), money_value(y), TOLERANCE), F.lit(False))
    return by_patterns(r, e, MONEY, same) | (matched(nr, ne) > 0)


#: Kinds whose answers the lenient check accepts whatever they hold.
ACCEPTED = ("number", "motion")
#: The kinds in the order in which they are tried: what of the question's type or of the expected answer calls for
#: them, and how they compare. A kind's answer is final only where it is a comparison of its own, as `final` says.
KINDS: dict[str, tuple[Callable[[Column, Column], Column], Callable]] = {
    "work": (lambda t, e: has(t, "công việc"), lambda r, e, nr, ne: by_patterns(r, e, WORK, near())),
    "candy": (lambda t, e: has(t, "chia kẹo") | has(e, "viên kẹo"), _candy),
    "mixture": (lambda t, e: has(t, "hỗn hợp") | has(e, "dung dịch"), lambda r, e, nr, ne: by_patterns(r, e, MIXTURE, near()) | (matched(nr, ne) > 0)),
    "number": (lambda t, e: has(t, "số học") | has(e, "tìm số"), _number),
    "geometry": (lambda t, e: has(t, "hình học") | (has(e, "diện tích") & has(e, "chu vi")), _geometry),
    "motion": (lambda t, e: has(t, "chuyển động") | has(e, "vận tốc", "hai xe"), lambda r, e, nr, ne: by_patterns(r, e, MOTION, near()) | _last_of(nr, ne, TOLERANCE)),
    "shares": (lambda t, e: has(t, "thơ toán học") | (has(e, "chia") & has(e, "dư")), _shares),
    "age": (lambda t, e: has(t, "tuổi") | has(e, "tuổi"), lambda r, e, nr, ne: by_patterns(r, e, AGE, same_text) | _last_of(nr, ne, CLOSE)),
    "pool": (lambda t, e: has(t, "hồ bơi") | has(e, "hồ nước", "bể bơi"), _pool),
    "fraction": (lambda t, e: has(t, "phân số") | has(e, "/"), _fraction),
    "money": (lambda t, e: has(t, "từ vựng") | has(e, "đồng", "giảm"), _money),
}


def final(kind: str, e: Column) -> Column:
    """Whether a kind's answer stands even if it is no: without such a number, and for area and perimeter together."""
    return has(e, *NO_NUMBER) if kind == "number" else has(e, "diện tích và chu vi") if kind == "geometry" else F.lit(False)


def question_kind(question_type: Column, expected: Column) -> Column:
    """The first kind that a question's type or its expected answer calls for; null if there is none."""
    t, e = F.lower(F.coalesce(question_type, F.lit(""))), F.lower(F.trim(expected))
    out = None
    for kind, (calls, _) in KINDS.items():
        out = F.when(calls(t, e), kind) if out is None else out.when(calls(t, e), kind)
    return out


def kind_match(response: Column, expected: Column, kind: str) -> Column:
    """Whether a response gives the expected answer by the comparison of one kind."""
    return let(lambda r, e: let(lambda nr, ne: KINDS[kind][1](r, e, nr, ne), answer_numbers(r), answer_numbers(e)), F.lower(F.trim(response)), F.lower(F.trim(expected)))


def _general(r: Column, e: Column, nr: Column, ne: Column) -> Column:
    """Most numbers, containment, or 70 % of the words."""
    n = F.size(ne)
    most = let(lambda k: (n > 0) & ((k >= F.greatest(F.lit(1.0), n * 0.7)) | ((k >= 1) & (n <= 2))), matched(nr, ne))
    parts = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: t != ""))
    share = lambda have, want: (F.size(want) > 0) & (F.size(F.array_intersect(want, have)) >= 0.7 * F.size(want))
    return most | F.contains(r, e) | let(share, parts(r), parts(e))


def checked(response: Column, expected: Column, question_type: Column, lenient: bool = True) -> Column:
    """Whether a response holds the expected answer: found, by, kind.

    Any number of one text that is a number of the other within 2 % decides
    (`number`); else the comparison of the question's kind (`kind`), whose no stands
    where it is final; else most numbers, containment, or 70 % of the words (`text`).
    Null and empty texts are no answer.
    """

    def parts(r: Column, e: Column, t: Column) -> Column:
        def decide(nr: Column, ne: Column) -> Column:
            # One condition chain, so that only the comparison of a row's own kind is evaluated.
            by_kind, stands, kind = None, None, None
            for name, (calls, compare) in KINDS.items():
                c = calls(t, e)
                if lenient and name in ACCEPTED:
                    compare = lambda r, e, nr, ne, own=compare, k=name: F.when(final(k, e), own(r, e, nr, ne)).otherwise(True)
                by_kind = F.when(c, compare(r, e, nr, ne)) if by_kind is None else by_kind.when(c, compare(r, e, nr, ne))
                stands = F.when(c, final(name, e)) if stands is None else stands.when(c, final(name, e))
                kind = F.when(c, F.lit(name)) if kind is None else kind.when(c, F.lit(name))
            number = _any_pair(nr, ne, lambda a, b: number_equal(a, b, TOLERANCE))
            by = F.when(number, F.lit("number")).when(F.coalesce(by_kind, F.lit(False)), F.lit("kind")).when(F.coalesce(stands, F.lit(False)), F.lit(None).cast("string")).when(_general(r, e, nr, ne), F.lit("text"))
            return F.struct(by.isNotNull().alias("found"), by.alias("by"), kind.alias("kind"))

        return let(decide, answer_numbers(r), answer_numbers(e))

    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    none = F.struct(F.lit(False).alias("found"), F.lit(None).cast("string").alias("by"), F.lit(None).cast("string").alias("kind"))
    return let(lambda r, e, t: F.when((r == "") | (e == ""), none).otherwise(parts(r, e, t)), low(response), low(expected), F.lower(F.coalesce(question_type, F.lit(""))))
