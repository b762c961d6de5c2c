"""Listing field extraction from page text / HTML (L1-L13, E11, F24, C17) - Column
expressions over arrays of lines, no Python UDF. Every function takes and returns
Columns, so a whole card is parsed inside one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import to_float_first, to_int_digits
from ..functions.text import collapse_ws

# Stop words and labels of the card layout.
BLOCK_HEADER = "характеристики"
BLOCK_STOP_WORDS = ["ипотека", "ипотека 16,9% для всех", "ипотека 16,9%",
                    "запланируйте просмотр", "рассчитайте ипотеку",
                    "что-то не так с объявлением?", "сообщите нам, и мы разберёмся в проблеме",
                    "сообщить об ошибке", "история цены"]
METRO_STOP_WORDS = ["в ипотеку от", "рассчитать платеж", "хотите скидку?", "описание",
                    "характеристики"]
METRO_BAD_STATIONS = ["на карте", "москва", "₽", "/мес."]
ADDRESS_LINE_MARKERS = ["ул.", "улица", "проспект", "проезд", "шоссе", "переулок", "бульвар",
                        "наб.", "набережная"]
CARD_LABELS = {
    "area_total": ["Общая площадь"],
    "kitchen_area": ["Площадь кухни"],
    "renovation": ["Ремонт", "Отделка"],
    "build_year": ["Год постройки", "Год сдачи"],
    "walls": ["Стены", "Материал стен"],
    "floor_info": ["Этаж/Этажность"],
    "rooms_value": ["Комнатность"],
    "ceiling_height": ["Высота потолков"],
    "floor_position": ["Расположение на этаже"],
    "elevator": ["Лифт"],
    "house_number": ["Номер дома"],
    "yard": ["Двор"],
    "parking": ["Парковка"],
    "playground": ["Детская площадка"],
}
# Line breaks of Python's ``splitlines``, and white space other than them and the plain space.
BREAKS = r"\n\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029"
SPACES = r"\t\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
NOWHERE = 1_000_000_000


def _in(x: Column, values: list[str]) -> Column:
    return F.array_contains(F.array(*[F.lit(v) for v in values]), x)


def normal_text(text: Column) -> Column:
    """L2: the cleaned non-empty lines as one text, a line feed between them. Texts that are clean
    already, which a few plain searches tell, are left as they are."""
    odd = text.rlike(rf"[{SPACES}\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029]|^[ \n]|[ \n]\z")
    for pair in ["  ", " \n", "\n ", "\n\n"]:
        odd = odd | text.contains(pair)
    runs = F.regexp_replace(F.regexp_replace(text, rf"[{SPACES} ]+", " "), rf" ?(?:[{BREAKS}] ?)+", "\n")
    return F.when(odd, F.regexp_replace(runs, r"\A[ \n]+|[ \n]+\z", "")).otherwise(text)


def split_lines(normal: Column) -> Column:
    """The lines of a ``normal_text``."""
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, "\n"))


def text_lines(text: Column) -> Column:
    """L2: lines (Python ``splitlines``), whitespace collapsed, empty ones dropped."""
    return split_lines(normal_text(text))


def extract_price(text: Column, normal: Column) -> Column:
    """L3: first whole line of digits/spaces (>= 6 chars) worth > 100,000; else the first
    'N руб' worth > 100,000. ``normal`` is ``normal_text(text)`` (pass a materialised column)."""
    whole = F.filter(F.regexp_extract_all(normal, F.lit(r"(?Um)^\d[\d ]{5,}$"), 0), lambda x: to_int_digits(x) > 100000)
    rub = F.filter(F.regexp_extract_all(text, F.lit(r"(?iU)(\d[\d\s]+)\s*руб"), 1),
                   lambda x: to_int_digits(x) > 100000)
    return F.coalesce(to_int_digits(F.try_element_at(whole, F.lit(1))), to_int_digits(F.try_element_at(rub, F.lit(1))))


COORD_RE = r"([5-6]\d\.\d{4,})\s*,\s*([3-4]\d\.\d{4,})"


def extract_coords(html: Column) -> Column:
    """L4: first 'lat, lon' pair inside 55..56 / 36..38 -> struct(latitude, longitude)."""
    lats = F.regexp_extract_all(html, F.lit(COORD_RE), 1)
    lons = F.regexp_extract_all(html, F.lit(COORD_RE), 2)
    pairs = F.transform(F.arrays_zip(lats.alias("la"), lons.alias("lo")), lambda p: F.struct(
        p["la"].cast("double").alias("latitude"), p["lo"].cast("double").alias("longitude")))
    ok = F.filter(pairs, lambda p: p["latitude"].between(55, 56) & p["longitude"].between(36, 38))
    return F.try_element_at(ok, F.lit(1))


def lower_lines(lines: Column) -> Column:
    """lower(trim(line)) for every line - computed once and reused by all lookups."""
    return F.transform(lines, lambda x: F.lower(F.trim(x)))


def _first_of(low: Column, words: list[str]) -> Column:
    """Smallest 0-based place of any of ``words`` in ``low``, ``NOWHERE`` or more if there is none.
    Plain searches for each word, as functions over array elements are not compiled."""
    at = [F.pmod(F.array_position(low, w) - 1, F.lit(2 * NOWHERE)) for w in words]
    return F.least(*at, F.lit(NOWHERE).cast("bigint")).cast("int")


def block_start(low: Column) -> Column:
    """1-based place after the LAST 'характеристики' line, NULL if there is none."""
    from_end = F.array_position(F.reverse(low), BLOCK_HEADER).cast("int")
    return F.size(low) - F.nullif(from_end, F.lit(0)) + 2


def _from(lines: Column, start: Column) -> Column:
    return F.slice(lines, start, F.greatest(F.size(lines) - start + 1, F.lit(0)))


def characteristics_block(lines: Column, low: Column | None = None) -> Column:
    """The lines after the LAST 'характеристики' line, up to the first stop word.
    ``low`` is ``lower_lines(lines)`` (pass a materialised column)."""
    low = lower_lines(lines) if low is None else low
    start = block_start(low)
    return _block(lines, start, _first_of(_from(low, start), BLOCK_STOP_WORDS))


def _block(lines: Column, start: Column, stop: Column) -> Column:
    return F.when(start.isNotNull(), F.slice(lines, start, F.greatest(F.least(stop, F.size(lines) - start + 1), F.lit(0)))) \
        .otherwise(F.array().cast("array<string>"))


def value_after_label(block: Column, labels: list[str], block_low: Column | None = None) -> Column:
    """The element after the first line equal (case-insensitively) to a label; the
    last line cannot be a label. ``block_low`` is ``lower_lines(block)`` (pass a materialised column)."""
    bl = lower_lines(block) if block_low is None else block_low
    return F.trim(F.get(block, _first_of(bl, [x.lower().strip() for x in labels]) + 1))


def floor_pair(value: Column) -> tuple[Column, Column]:
    """L7: 'N из M' else 'N/M' -> (floor, floors_total)."""
    a = r"(?iu)(\d+)\s+из\s+(\d+)"
    b = r"(\d+)\s*/\s*(\d+)"
    of, slash = [[F.regexp_extract(value, p, k) for k in (1, 2)] for p in (a, b)]
    return tuple(F.when(x != "", x).when(y != "", y).cast("int") for x, y in zip(of, slash))


def floor_pair_old(text: Column) -> tuple[Column, Column]:
    """L7, old cards: the first 'N/M этаж' of the page text -> (floor, floors_total)."""
    p = r"(?iu)(\d+)\s*/\s*(\d+)\s*этаж"
    return tuple(F.when(text.rlike(p), F.regexp_extract(text, p, k)).cast("int") for k in (1, 2))


# Street markers of old cards.
OLD_ADDRESS_MARKERS = ["ул.", "улица", "пос", "проезд", "пр-т", "шоссе", "б-р"]


def address_line_old(lines: Column) -> Column:
    """L9, old cards: the first line with a street marker, whatever city it names."""
    return F.try_element_at(F.filter(lines, lambda x: _has_any(F.lower(x), OLD_ADDRESS_MARKERS)), F.lit(1))


def rooms_from(value: Column, text: Column) -> Column:
    """Number in the value, else 'N-комн', else 'Nк,', else 0 for a studio."""
    v = F.regexp_extract(value, r"(\d+)", 1)
    a = F.regexp_extract(text, r"(?iu)(\d+)\s*-\s*комн", 1)
    b = F.regexp_extract(text, r"(?iu)(\d+)к,", 1)
    return (F.when(value.isNotNull() & (v != ""), v.cast("int"))
            .when(a != "", a.cast("int"))
            .when(b != "", b.cast("int"))
            .when(F.lower(text).contains("студия"), F.lit(0)))


def _has_any(low: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | low.contains(w)
    return cond


def address_line(lines: Column, low: Column | None = None) -> Column:
    """First 'москва, ...' line with a street marker and no phone/show words; else the
    first line mentioning москва + квартира + этаж. ``low`` is ``lower_lines(lines)``."""
    low = lower_lines(lines) if low is None else low
    said = F.array_compact(F.transform(lines, lambda x, i: F.when(F.get(low, i).contains("москва"), F.struct(
        x.alias("line"), F.get(low, i).alias("low")))))
    ok = F.filter(said, lambda s: ~s["low"].contains("тел.") & ~s["low"].contains("показать"))
    first = F.filter(ok, lambda s: s["low"].startswith("москва,") & _has_any(s["low"], ADDRESS_LINE_MARKERS))
    second = F.filter(ok, lambda s: s["low"].contains("квартира") & s["low"].contains("этаж"))
    return F.coalesce(F.try_element_at(first, F.lit(1))["line"], F.try_element_at(second, F.lit(1))["line"])


def metro_line(lines: Column, low: Column | None = None) -> Column:
    """L10 + F24: in the <= 17 lines after 'на карте' (until a stop word) collect
    (station, minutes) from 'N мин' lines (station = previous line) and from
    'Station N мин' lines; return the candidate with the fewest minutes (first on tie)
    as struct(minutes, ord, station)."""
    low = lower_lines(lines) if low is None else low
    start = metro_start(low)
    return metro_nearest(metro_candidates(lines, low, start, metro_end(low, start)))


def metro_start(low: Column) -> Column:
    """1-based place of the 'на карте' line, NULL if there is none."""
    return F.nullif(F.array_position(low, "на карте").cast("int"), F.lit(0))


def metro_end(low: Column, start: Column) -> Column:
    """1-based place of the last line looked at."""
    last = F.least(start + 17, F.size(low))
    stop = _first_of(F.slice(low, start + 1, F.greatest(last - start, F.lit(0))), METRO_STOP_WORDS)
    return F.least(start + stop, last)


def metro_candidates(lines: Column, low: Column, start: Column, end: Column) -> Column:
    """The lines that speak of minutes, each with the line before it. Pass materialised columns."""
    win = F.when(start < end, F.sequence(start + 1, end)).when(start.isNotNull(), F.array().cast("array<int>"))
    timed = F.filter(win, lambda i: F.get(low, i - 1).contains("мин"))
    return F.transform(timed, lambda i: F.struct(
        i.alias("i"), F.get(lines, i - 1).alias("line"), F.get(lines, i - 2).alias("prev"), F.get(low, i - 2).alias("prev_low"),
        F.regexp_extract(F.get(low, i - 1), r"^(\d+)\s*мин", 1).alias("m")))


def metro_nearest(timed: Column) -> Column:
    """The best of the ``metro_candidates``. Lines are collapsed already."""
    pat = r"^([А-Яа-яЁёA-Za-z\-\s]+)\s+(\d+)\s*мин"
    below = F.transform(F.filter(timed, lambda c: (c["m"] != "") & ~c["prev_low"].isin(METRO_BAD_STATIONS) & F.length(c["prev"]).between(2, 40)),
                        lambda c: F.struct(c["m"].cast("int").alias("minutes"), (c["i"] * 2).alias("ord"), c["prev"].alias("station")))
    beside = F.transform(F.filter(timed, lambda c: F.length(F.regexp_extract(c["line"], pat, 1)).between(2, 40)), lambda c: F.struct(
        F.regexp_extract(c["line"], pat, 2).cast("int").alias("minutes"), (c["i"] * 2 + 1).alias("ord"),
        F.regexp_extract(c["line"], pat, 1).alias("station")))
    return F.array_min(F.concat(below, beside))


def card_fields(text: Column, normal: Column, v: dict[str, Column], address: Column, metro: Column) -> dict[str, Column]:
    """L13 without link/group/html: every card field, from the text, its cleaned lines, the labelled
    values, the address line and the nearest station. Pass materialised columns so the expression stays small."""
    floor, floors_total = floor_pair(v["floor_info"])
    return {
        "price": extract_price(text, normal),
        "area_total": to_float_first(v["area_total"]),
        "rooms": rooms_from(v["rooms_value"], text),
        "floor": floor, "floors_total": floors_total,
        "address": address,
        "metro": metro["station"], "metro_walk_min": metro["minutes"],
        "kitchen_area": to_float_first(v["kitchen_area"]),
        "renovation": v["renovation"], "walls": v["walls"],
        "build_year": to_int_digits(v["build_year"]).cast("int"),
        "ceiling_height": to_float_first(v["ceiling_height"]),
        "floor_position": v["floor_position"], "elevator": v["elevator"],
        "house_number": v["house_number"], "yard": v["yard"], "parking": v["parking"],
        "playground": v["playground"],
    }


def with_block(cards: DataFrame, text: str = "text") -> DataFrame:
    """L2 + L5 step by step: adds the cleaned text, its lines and the characteristics block, each also
    in lower case."""
    return (cards.withColumn("_normal", normal_text(F.col(text)))
            .withColumns({"_lines": split_lines(F.col("_normal")), "_low": split_lines(F.lower("_normal"))})
            .withColumn("_start", block_start(F.col("_low")))
            .withColumn("_stop", _first_of(_from(F.col("_low"), F.col("_start")), BLOCK_STOP_WORDS))
            .withColumns({"_block": _block(F.col("_lines"), F.col("_start"), F.col("_stop")),
                          "_block_low": _block(F.col("_low"), F.col("_start"), F.col("_stop"))}))


def card_rows(cards: DataFrame, text: str = "text", html: str | None = None) -> DataFrame:
    """The 23-column card record per page (coordinates from HTML when given). Lines
    and the characteristics block are materialised as columns first: every field reads
    them, and inlining them into each field would multiply the expression tree."""
    staged = (with_block(cards, text)
              .withColumns({**{f"_v_{k}": value_after_label(F.col("_block"), labels, F.col("_block_low"))
                               for k, labels in CARD_LABELS.items()},
                            "_address": address_line(F.col("_lines"), F.col("_low")),
                            "_from": metro_start(F.col("_low"))})
              .withColumn("_to", metro_end(F.col("_low"), F.col("_from")))
              .withColumn("_timed", metro_candidates(F.col("_lines"), F.col("_low"), F.col("_from"), F.col("_to")))
              .withColumn("_metro", metro_nearest(F.col("_timed"))))
    f = card_fields(F.col(text), F.col("_normal"), {k: F.col(f"_v_{k}") for k in CARD_LABELS},
                    F.col("_address"), F.col("_metro"))
    coords = extract_coords(F.col(html)) if html else F.lit(None).cast(
        "struct<latitude:double,longitude:double>")
    tmp = staged.withColumn("_c", coords)
    f |= {c: F.col("_c")[c] for c in ("latitude", "longitude")}
    cols = ["source_group", "price", "area_total", "rooms", "floor", "floors_total", "address",
            "latitude", "longitude", "metro", "metro_walk_min", "kitchen_area", "renovation",
            "walls", "build_year", "ceiling_height", "floor_position", "elevator",
            "house_number", "yard", "parking", "playground", "link"]
    keep = [c for c in cards.columns if c not in cols and c not in (text, html)]
    return tmp.select(*keep, *[f[c].alias(c) if c in f else F.col(c) for c in cols])


# ------------------------------------------------------------------ old layout
def total_area_old(text: Column, lines: Column, low: Column | None = None) -> Column:
    """Area from 'квартира, X м²', else the line after 'общая площадь'."""
    m = F.regexp_extract(text, r"(?iu)квартира,\s*(\d+(?:[.,]\d+)?)\s*м[²2]", 1)
    lab = value_after_label(lines, ["общая площадь"], low)
    return F.when(m != "", to_float_first(m)).otherwise(to_float_first(lab))


def last_value_after(lines: Column, label: str, low: Column | None = None) -> Column:
    """The value after the LAST line equal to ``label`` (later matches win). ``low`` holds the
    lowered lines (pass a materialised column)."""
    low = F.transform(lines, F.lower) if low is None else low
    n = F.size(lines)
    from_end = F.array_position(F.reverse(F.slice(low, 1, F.greatest(n - 1, F.lit(0)))), label).cast("int")
    return F.when(from_end > 0, F.try_element_at(lines, n - from_end + 1))


OLD_METRO_BAD = ["на карте", "карта", "ипотека", "показать телефон", "продаётся только у нас",
                 "своя ставка"]


def metro_from_blocks(blocks: Column) -> Column:
    """Over short (<= 200 chars) blocks containing 'мин', every
    'Station N мин' match; the fewest minutes wins (first on tie)."""
    pat = r"([А-Яа-яЁёA-Za-z\-\s]+?)\s+(\d+)\s*мин"
    ok = F.filter(F.transform(F.filter(blocks, lambda b: b.contains("мин")), collapse_ws), lambda b: F.length(b) <= 200)
    per = F.transform(ok, lambda b, bi: F.transform(
        F.regexp_extract_all(b, F.lit(pat), 0),
        lambda p, pi: F.struct(F.regexp_extract(p, pat, 2).cast("int").alias("minutes"),
                               (bi * 1000 + pi).alias("ord"),
                               collapse_ws(F.regexp_extract(p, pat, 1)).alias("station"))))
    cands = F.filter(F.flatten(per), lambda c: (c["station"] != "") & (F.length(c["station"]) < 60)
                     & ~_in(F.lower(c["station"]), OLD_METRO_BAD))
    return F.array_min(cands)


# ------------------------------------------------------------------ link pages
def page_links(html: Column, page_url: Column, path_re: str = r"/realty/\d+/?$") -> Column:
    """L1: hrefs -> drop the query string -> keep paths matching ``path_re`` ->
    absolute (relative hrefs take the page's scheme and host) -> distinct, sorted."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""href\s*=\s*["']([^"']*)["']"""), 1)
    base = F.regexp_extract(page_url, r"^(https?://[^/?#]+)", 1)
    no_q = F.transform(hrefs, lambda h: F.split(h, r"\?")[0])
    keep = F.filter(no_q, lambda h: h.rlike(path_re))
    absolute = F.transform(keep, lambda h: F.when(h.startswith("http"), h)
                           .otherwise(F.concat(base, h)))
    return F.array_sort(F.array_distinct(absolute))


_DROPPED = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
_TRACKED = ["li", "a", "ul", "ol"]


def element_texts(pages: DataFrame, html: str, out: str) -> DataFrame:
    """Adds ``out``: the texts of all <li> and <a> elements, text nodes trimmed and joined by a space.
    A stack of open tags is folded over the tags of the page, so nested elements each keep their
    whole text. A closing tag closes what is open inside its element; a <li> ends the <li> before it
    in the same list, an <a> the <a> around it; what is never closed ends with the page."""
    tokens = F.regexp_extract_all(F.regexp_replace(F.col(html), _DROPPED, ""), F.lit(r"<[^>]*>|[^<]+"), 0)
    df = pages.withColumn("_tokens", F.coalesce(tokens, F.array().cast("array<string>")))
    events = F.filter(F.transform("_tokens", lambda t, i: F.struct(
        F.lower(F.regexp_extract(t, r"^<(/?[a-zA-Z]+)", 1)).alias("tag"), i.alias("at"))),
        lambda e: e["tag"].isin([*_TRACKED, *["/" + t for t in _TRACKED]]))
    df = df.withColumn("_events", events)
    stack_type, span_type = "array<struct<tag:string,at:int>>", "array<struct<tag:string,low:int,high:int>>"
    start = F.struct(F.array().cast(stack_type).alias("stack"), F.array().cast(span_type).alias("done"))

    def last_of(stack, *tags):
        """1-based place of the innermost open element of the tags, 0 if there is none."""
        back = F.transform(F.reverse(stack), lambda x: x["tag"].isin(list(tags)) if len(tags) > 1 else x["tag"] == tags[0])
        at = F.array_position(back, True)
        return F.when(at > 0, F.size(stack) - at + 1).otherwise(0).cast("int")

    def closed(state, place, at):
        """The state after closing the element at ``place`` and all inside it."""
        inner = F.slice(state["stack"], place, F.size(state["stack"]) - place + 1)
        return F.struct(
            F.slice(state["stack"], 1, place - 1).alias("stack"),
            F.concat(state["done"], F.transform(inner, lambda x: F.struct(
                x["tag"].alias("tag"), x["at"].alias("low"), at.alias("high")))).alias("done"))

    def step(state, event):
        tag, at, stack = event["tag"], event["at"], state["stack"]
        closing = tag.startswith("/")
        name = F.regexp_replace(tag, "/", "")
        of_name = F.array_position(F.reverse(F.transform(stack, lambda x: x["tag"])), name)
        named = F.when(of_name > 0, F.size(stack) - of_name + 1).otherwise(0)
        item = last_of(stack, "li", "ul", "ol")
        before = F.when(tag == "li", F.when(F.try_element_at(stack, F.greatest(item, F.lit(1)))["tag"] == "li", item).otherwise(0)) \
            .when(tag == "a", named).otherwise(0)
        place = F.when(closing, named).otherwise(F.coalesce(before, F.lit(0))).cast("int")
        after = F.when(place > 0, closed(state, F.greatest(place, F.lit(1)), at)).otherwise(state)
        return F.struct(
            F.when(closing, after["stack"]).otherwise(F.concat(after["stack"], F.array(F.struct(
                tag.alias("tag"), at.alias("at"))))).alias("stack"), after["done"].alias("done"))

    end = F.size("_tokens")
    spans = F.aggregate("_events", start, step, lambda s: F.concat(s["done"], F.transform(s["stack"], lambda x: F.struct(
        x["tag"].alias("tag"), x["at"].alias("low"), end.alias("high")))))
    df = df.withColumn("_spans", F.filter(spans, lambda x: x["tag"].isin("li", "a")))
    texts = F.transform("_spans", lambda x: F.array_join(F.filter(F.transform(
        F.slice(F.col("_tokens"), x["low"] + 2, F.greatest(x["high"] - x["low"] - 1, F.lit(0))),
        lambda t: F.when(t.startswith("<"), "").otherwise(F.regexp_replace(t, r"^\s+|\s+$", ""))), lambda t: t != ""), " "))
    return df.withColumn(out, texts).drop("_tokens", "_events", "_spans")


def whitelist_tokens(pages: DataFrame, html: str, out: str) -> DataFrame:
    """C17: adds the <li>/<a> texts, whitespace-normalised with ё -> е, 3..40 chars, no menu words."""
    from ..functions.text import WHITELIST_MENU_WORDS, normalize_station
    texts = F.transform("_texts", lambda t: normalize_station(t))
    return element_texts(pages, html, "_texts").withColumn(out, F.filter(
        texts, lambda t: F.length(t).between(3, 40) & ~_has_any(F.lower(t), WHITELIST_MENU_WORDS))).drop("_texts")
