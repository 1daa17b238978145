"""Language of a text by its scripts and by votes of common words."""

from __future__ import annotations

import re
import unicodedata

#: Common words by language. Vietnamese is also recognised without accents.
COMMON = {
    "vi": """là và của cho với các những được không khi thì mà nếu nên vì để từ trong này đó rồi lại cùng cũng đã đang sẽ hãy bị
    như theo mỗi vào ra trên ta hỏi bao nhiêu phải còn tất cả sau trước bằng đến hơn do đây một hai ba bước vậy kết luận đáp
    số giờ tổng phần có bạn mình tính lấy chia gọi tìm chữ đồng lít phút tuổi năm giá tiền mua người chiếc cây viên bông quả
    con quyển hạt tấm thêm khoảng gặp nhau cách xe nước cạnh diện tích chu vi đề bài lời giải kết quả trả lời dữ kiện thời gian""",
    "en": """the of and is are was were to that a an with from this these it its each how if then than by at on as be has have they
    their we you what which when where after before but not find so for in per hour hours step answer final therefore gets left
    over total job about dividing together makes times into does do there shares equally many much cost costs pays buyer coins""",
    "es": """el la los las un una que de y en por para con es del al se su luego este esta ese esa tanto respuesta resultado sumamos
    obtener cuenta hay tener así después como más pero son primero suma cuya datos empezamos valor""",
    "fr": """le la les des un une que de et en par pour avec est du au se son ce cette ces puis ensuite ainsi donc réponse résultat
    nous on il faut cette alors plus mais sont d'abord commençons obtient valeur partage parts aussi vérifier reste""",
    "de": """der die das und ist nicht ein eine mit von zu den dem des wird werden also auf auch dann dieser diese danach zuerst wir
    antwort ergebnis lautet somit sind beiden ihre summe beträgt gegeben seiten einheiten erhalten""",
    "id": """yang dan di dari untuk dengan ini itu adalah pada tidak akan kita jadi maka setelah kemudian hasil hasilnya jawabannya
    pertama bilangan dua yaitu jumlahnya dengan demikian diperoleh sehingga langkah harus sudah sama diketahui perhatikan""",
    "pt": """o os um uma que de e em por para com é do da dos das ao se sua então depois primeiro resposta resultado portanto não
    são mais mas temos valor""",
    "it": """il lo gli un una che di e in per con è del della dei al si suo quindi poi prima risposta risultato sono più ma abbiamo
    dunque valore""",
}
_WORD = re.compile(r"[^\W\d_]+")
_VIETNAMESE = re.compile("[ăâđêôơưĂÂĐÊÔƠƯẠ-ỹ]")
_SCRIPTS = (
    ("ja", re.compile("[぀-ヿ]")),
    ("zh", re.compile("[一-鿿]")),
    ("ko", re.compile("[가-힯]")),
    ("th", re.compile("[฀-๿]")),
    ("ru", re.compile("[Ѐ-ӿ]")),
    ("ar", re.compile("[؀-ۿ]")),
    ("hi", re.compile("[ऀ-ॿ]")),
    ("el", re.compile("[Ͱ-Ͽ]{2,}")),
)
_OTHER_SCRIPT = re.compile("|".join(script.pattern for _, script in _SCRIPTS))
#: A letter of a script of its own weighs as much as so many votes of words.
_PER_LETTER = 0.4


def _votes() -> dict[str, tuple[str, ...]]:
    table: dict[str, set[str]] = {}
    for lang, words in COMMON.items():
        for w in words.split():
            table.setdefault(w, set()).add(lang)
            if lang == "vi":
                plain = "".join(c for c in unicodedata.normalize("NFD", w.replace("đ", "d")) if not unicodedata.combining(c))
                if len(plain) > 1:
                    table.setdefault(plain, set()).add(lang)
    return {w: tuple(sorted(x)) for w, x in table.items()}


VOTES = _votes()


def votes(text: str) -> dict[str, float]:
    """Votes for each language. A word shared by languages divides its vote among them."""
    out: dict[str, float] = {}
    if not text.isascii():
        for lang, script in _SCRIPTS:
            n = len(script.findall(text))
            if n:
                out[lang] = out.get(lang, 0) + n * _PER_LETTER
        if "ja" in out and "zh" in out:  # Japanese is written with both
            out["ja"] += out.pop("zh")
    for w in _WORD.findall(text.lower()):
        langs = VOTES.get(w)
        if langs:
            for lang in langs:
                out[lang] = out.get(lang, 0) + 1 / len(langs)
        elif not w.isascii() and _VIETNAMESE.search(w):
            out["vi"] = out.get("vi", 0) + 1
    return out


def language(text: str) -> tuple[str, float, float]:
    """The language with most votes, its votes, and its share of all votes; '' without any."""
    v = votes(text)
    if not v:
        return "", 0.0, 0.0
    best = max(sorted(v), key=v.__getitem__)
    return best, v[best], v[best] / sum(v.values())


_OWN = {lang: frozenset(w for w, x in VOTES.items() if x == (lang,)) for lang in COMMON}
_RIVALS = {lang: frozenset(w for w, x in VOTES.items() if lang not in x) for lang in COMMON}


def same_at_once(text: str, lang: str) -> bool:
    """Whether so many of a text's different words are of one language that no count is needed.

    True only if a quarter of them, and at least eight, are words of this language
    alone, at most a tenth of that are words of others, and no letter is of a script
    of another language, as those may have no blanks to count words by; False says
    nothing.
    """
    if lang not in _OWN or not text.isascii() and _OTHER_SCRIPT.search(text):
        return False
    words = set(text.lower().split())
    own = len(words & _OWN[lang])
    return own >= 8 and own * 4 >= len(words) and len(words & _RIVALS[lang]) * 10 <= own
