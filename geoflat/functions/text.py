"""Text cleaning and category normalisation as Column expressions.

Regex notes: Java's ``(?i)`` does not fold Cyrillic, so case-insensitive patterns use
``(?iu)``; ``\\s`` excludes NBSP unless ``(?U)`` is on; SQL ``trim`` strips spaces only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The signs that Java's ``(?U)\\s`` matches.
UNICODE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def py_strip(c) -> Column:
    """Python ``str.strip()``: any Unicode whitespace at both ends."""
    return F.trim(_c(c).cast("string"), F.lit(UNICODE_SPACE))


def collapse_ws(c) -> Column:
    """C5 ``clean``: whitespace runs -> one space, stripped (keeps '')."""
    return py_strip(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def clean_text(c) -> Column:
    """C5 ``clean_text``: collapse_ws, blank -> NULL."""
    t = collapse_ws(c)
    return F.when(t != "", t)


def is_empty(c) -> Column:
    """NULL or blank after strip."""
    return _c(c).isNull() | (py_strip(_c(c)) == "")


def fill_norm_category(c) -> Column:
    """NULL -> 'unknown', strip, lower ('' stays '')."""
    return F.lower(py_strip(F.coalesce(_c(c).cast("string"), F.lit("unknown"))))


def normalize_station(c) -> Column:
    """Strip, collapse whitespace, ё -> е."""
    return F.translate(collapse_ws(c), "ёЁ", "еЕ")


def multi_category(c) -> Column:
    """C9: 'A, B' == 'b ,a' -> 'a, b'; blank/NULL -> 'unknown'."""
    parts = F.filter(F.transform(F.split(_c(c), ","), lambda x: F.lower(py_strip(x))),
                     lambda x: x != "")
    joined = F.array_join(F.array_sort(F.array_distinct(parts)), ", ")
    return F.when(is_empty(c), F.lit("unknown")).otherwise(
        F.when(joined == "", F.lit("unknown")).otherwise(joined))


# Keyword flags of normalised parking / elevator strings.
PARKING_FLAGS = {
    "parking_underground": "подзем",
    "parking_ground": "назем",
    "parking_multilevel": "многоуров|многоуровнев",
    "parking_open": "открыт",
}
ELEVATOR_FLAGS = {
    "elevator_passenger": "пассажир",
    "elevator_cargo": "груз",
}


def keyword_flag(c, pattern: str) -> Column:
    """0/1 regex hit (NULL -> 0)."""
    return F.coalesce(_c(c).rlike(pattern).cast("int"), F.lit(0))


def _has(v: Column, *words: str) -> Column:
    cond = None
    for w in words:
        hit = v.contains(w)
        cond = hit if cond is None else (cond | hit)
    return cond


def walls_en(c) -> Column:
    """C11: ordered rules; 'кирпично-монолитный' is monolith."""
    v = F.lower(_c(c).cast("string"))
    return (F.when(is_empty(c), "unknown")
            .when(_has(v, "монолит"), "monolith")
            .when(_has(v, "кирп"), "brick")
            .when(_has(v, "панел"), "panel")
            .when(_has(v, "блок"), "block")
            .otherwise("other"))


def walls_ru(c) -> Column:
    """Older rule set with 'железобетон'; fallback is the lower-cased text."""
    t = clean_text(c)
    v = F.lower(t)
    return (F.when(t.isNull(), F.lit(None).cast("string"))
            .when(_has(v, "монолит"), "монолит")
            .when(_has(v, "кирп"), "кирпич")
            .when(_has(v, "панел"), "панель")
            .when(_has(v, "железобетон"), "железобетон")
            .when(_has(v, "блок"), "блок")
            .otherwise(v))


def renovation_norm(c) -> Column:
    """C13."""
    v = F.lower(_c(c).cast("string"))
    return (F.when(is_empty(c), "unknown")
            .when(_has(v, "без ремонта", "требует", "чернов"), "no_repair")
            .when(_has(v, "дизайнер"), "designer")
            .when(_has(v, "евро", "современ", "хорош", "качествен"), "good")
            .when(_has(v, "космет"), "cosmetic")
            .otherwise("other"))


# Address cleaning patterns and markers.
ADDRESS_ROOM_PREFIX_FULL = r"(?iu)^\s*\d+\s*к\s*,\s*\d+(?:[.,]\d+)?\s*м[²2]\s*,\s*\d+(?:/\d+)?\s*этаж\s*,\s*"
ADDRESS_ROOM_PREFIX_PART = r"(?iu)^\s*\d+\s*к\s*,\s*\d+(?:[.,]\d+)?\s*м[²2]\s*,\s*"
ADDRESS_MARKERS_RE = r"(ул\.|улица|просп|пр-т|шоссе|проезд|переул|пер\.|пос[её]лок|б-р|бульвар|наб\.|набережная)"
ADDRESS_BAD_EXACT = ["на карте", "карта", "показать телефон", "ипотека"]


def clean_address(c, variant: str = "script") -> Column:
    """C14: junk -> NULL, prefixes / service tails removed, NULL if < 8 chars or no
    street marker. ``variant='script'`` (anchored photo junk) or ``'notebook'``."""
    t = clean_text(c)
    if variant == "script":
        junk = t.rlike(r"(?iu)^Посмотреть \d+ фото$")
        x = py_strip(F.regexp_replace(t, r"(?iu)^На карте\s+", ""))
        x = F.regexp_replace(x, ADDRESS_ROOM_PREFIX_FULL, "")
        x = F.regexp_replace(x, ADDRESS_ROOM_PREFIX_PART, "")
        x = py_strip(F.regexp_replace(x, r"(?iu),\s*(квартира|апартаменты)\s*$", ""))
        x = py_strip(F.regexp_replace(x, r"(?iu)Показать телефон.*$", ""))
        x = py_strip(F.regexp_replace(x, r"(?iu)Записаться на просмотр.*$", ""))
        x = py_strip(F.regexp_replace(x, r"(?iu)Ипотека.*$", ""))
    else:
        low = F.lower(t)
        junk = low.rlike(r"(?U)посмотреть\s+\d+\s+фото") | low.isin(*ADDRESS_BAD_EXACT)
        x = py_strip(F.regexp_replace(t, r"(?iu)^На карте\s+", ""))
        x = py_strip(F.regexp_replace(x, r"(?iu)Показать телефон.*$", ""))
        x = py_strip(F.regexp_replace(x, r"(?iu)Записаться на просмотр.*$", ""))
        x = py_strip(F.regexp_replace(x, r"(?iu)Ипотека.*$", ""))
        x = F.regexp_replace(x, ADDRESS_ROOM_PREFIX_FULL, "")
        x = F.regexp_replace(x, ADDRESS_ROOM_PREFIX_PART, "")
        x = py_strip(F.regexp_replace(x, r"(?iu),\s*(квартира|апартаменты)\s*$", ""))
        x = collapse_ws(x)
    ok = (F.length(x) >= 8) & F.lower(x).rlike(ADDRESS_MARKERS_RE)
    return F.when(t.isNotNull() & ~junk & ok, x)


# Old metro rule.
METRO_BAD_EXACT_OLD = ["находится в", "ипотека", "показать телефон", "карта", "на карте"]
METRO_TWO_WORD_PREFIXES = [
    "Верхние Лихоборы", "Деловой центр", "Мичуринский проспект", "Рязанский проспект",
    "Октябрьское Поле", "Пятницкое шоссе", "Лермонтовский проспект",
    "Проспект Вернадского", "Нижегородская улица",
]
NON_NAME_CHARS = r"(?U)[^\w\sА-Яа-яЁё\-]"


def clean_metro_rule(c) -> Column:
    """First station phrase of a glued metro string."""
    t = py_strip(F.regexp_replace(clean_text(c), r"(?iu)^На карте\s+", ""))
    words = F.split(t, " ")
    first_two = F.array_join(F.slice(words, 1, 2), " ")
    picked = (F.when(F.size(words) >= 3,
                     F.when(first_two.isin(*METRO_TWO_WORD_PREFIXES), first_two)
                     .otherwise(F.element_at(words, 1)))
              .otherwise(t))
    x = collapse_ws(F.regexp_replace(picked, NON_NAME_CHARS, ""))
    bad = F.lower(t).isin(*METRO_BAD_EXACT_OLD)
    return F.when(t.isNotNull() & (t != "") & ~bad & F.length(x).between(3, 40), x)


# Metro white-list matcher.
METRO_BAD_WORDS = ["в", "до", "метро", "до метро", "на карте", "карта", "всего",
                   "показать телефон", "ипотека"]


def metro_candidate_text(c) -> Column:
    """C16 pre-clean: drop '(x км)', 'На карте', punctuation; normalise the name."""
    t = clean_text(c)
    x = F.regexp_replace(t, r"(?iu)\(\s*\d+(?:[.,]\d+)?\s*км\s*\)", "")
    x = F.regexp_replace(x, r"(?iu)^На карте\s+", "")
    x = F.regexp_replace(x, NON_NAME_CHARS, " ")
    x = normalize_station(x)
    bad = F.lower(x).isin(*METRO_BAD_WORDS) | F.lower(x).contains("до метро")
    return F.when(t.isNotNull() & (x != "") & ~bad, x)


# White-list page filters.
WHITELIST_MENU_WORDS = ["список", "станции метро москвы", "по алфавиту", "главная", "меню"]
