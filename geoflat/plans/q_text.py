"""Registered queries: card field extraction, link pages, address / metro text cleaning,
white-list matching. Oracles compute the expected fields directly from the rows the
texts were generated from (lineitem), so they check the extraction independently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import to_float_first
from ..operators import extract as E
from ..sources import fixtures as X
from ..sources.fixtures import K_EXPR, LISTING_EXPRS, oracle_with
from ..sources.tables import read_table
from .catalog import query

LID = dict(LISTING_EXPRS)["listing_id"]
_LI = f"(SELECT *, {K_EXPR} AS k FROM lineitem)"
CHR10 = "chr(10)"


def _k_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").withColumn("k", F.expr(K_EXPR)).withColumn(
        "listing_id", F.expr(LID))


# ------------------------------------------------------------------ card text
@query("text_lines", sql=oracle_with("cards") + """
, l AS (SELECT listing_id, list_filter(list_transform(string_split(text, chr(10)),
                 lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM cards)
SELECT listing_id, CAST(len(lines) AS INTEGER) AS n_lines, lines[1] AS first_line,
       lines[len(lines)] AS last_line FROM l""")
def q_text_lines(spark, sf_dir):
    """L2 (+ C5 per line): cleaned non-empty lines of every card text."""
    c = X.cards(spark, sf_dir).select("listing_id", E.text_lines(F.col("text")).alias("lines"))
    return c.select("listing_id", F.size("lines").alias("n_lines"),
                    F.try_element_at("lines", F.lit(1)).alias("first_line"),
                    F.try_element_at("lines", F.lit(-1)).alias("last_line"))


_CARD_TRUTH = f"""
SELECT l_returnflag AS source_group, CAST(NULL AS BIGINT) AS price, l_quantity * 3e0 AS area_total,
       CAST(NULL AS INTEGER) AS rooms,
       CAST(coalesce(CASE WHEN k % 17 = 0 THEN NULL ELSE 1 + k % 31 END, 0) AS INTEGER) AS floor,
       CAST(coalesce(CASE WHEN k % 19 = 0 THEN NULL ELSE 1 + k % 37 END, 0) AS INTEGER) AS floors_total,
       'Москва, ул. Тестовая, ' || CAST(k % 100 AS VARCHAR) AS address,
       CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
       'Станция' AS metro, CAST(1 + k % 40 AS INTEGER) AS metro_walk_min,
       CAST(NULL AS DOUBLE) AS kitchen_area, CAST(NULL AS VARCHAR) AS renovation,
       coalesce(CASE k % 6 WHEN 0 THEN 'Монолитный' WHEN 1 THEN 'Кирпично-монолитный'
                WHEN 2 THEN 'Кирпичный' WHEN 3 THEN 'Панельный' WHEN 4 THEN 'деревянный' END, '—') AS walls,
       CAST(NULL AS INTEGER) AS build_year, CAST(NULL AS DOUBLE) AS ceiling_height,
       CAST(NULL AS VARCHAR) AS floor_position, CAST(NULL AS VARCHAR) AS elevator,
       CAST(NULL AS VARCHAR) AS house_number, CAST(NULL AS VARCHAR) AS yard,
       CAST(NULL AS VARCHAR) AS parking, CAST(NULL AS VARCHAR) AS playground,
       {dict(LISTING_EXPRS)['link']} AS link, {LID} AS listing_id
FROM {_LI}"""


@query("card_rows", sql=_CARD_TRUTH)
def q_card_rows(spark, sf_dir):
    """L13 with L5 (block after the last header, cut at 'История цены'), L6/E11 labelled
    values, L7 floor pair, L8 rooms, L9 address, L10/F24 metro + minutes."""
    return E.card_rows(X.cards(spark, sf_dir))


# A card with every label, both price forms, both address forms, stations above and beside their
# minutes with ties, both floor forms and both names of the labels that have two.
_FULL_CARD_TEXT = """concat_ws(chr(10), 'Купить квартиру',
  if(k % 3 = 0, concat_ws(' ', cast(2 + k % 9 as string), lpad(cast(k % 1000 as string), 3, '0'), '000'),
     concat('Цена ', concat_ws(' ', cast(2 + k % 9 as string), lpad(cast(k % 1000 as string), 3, '0'), '000'), ' руб.')),
  if(k % 2 = 0, concat('Москва, ул. Тестовая, ', cast(k % 100 as string)), '2-комн. квартира, Москва, 5 этаж'),
  'На карте', 'Станция А', concat(cast(1 + k % 20 as string), ' мин.'),
  concat('Станция-Б ', cast(1 + k % 15 as string), ' мин'), 'Станция В', concat(cast(1 + k % 20 as string), ' мин. пешком'),
  'Описание', 'Станция Г', '1 мин.', 'Характеристики', 'старый заголовок', 'Характеристики',
  'Общая площадь', concat(cast(20 + k % 90 as string), ',5 м²'), 'Площадь кухни', concat(cast(5 + k % 10 as string), ' м²'),
  if(k % 2 = 0, 'Ремонт', 'ОТДЕЛКА'), 'Евро', if(k % 2 = 0, 'Год сдачи', 'Год постройки'), concat(cast(1950 + k % 70 as string), ' год'),
  'Стены', 'Панельный', 'Этаж/Этажность', concat(cast(1 + k % 9 as string), if(k % 4 = 0, '/', ' из '), cast(9 + k % 9 as string)),
  'Комнатность', if(k % 5 = 0, '—', cast(1 + k % 4 as string)), 'Высота потолков', if(k % 2 = 0, '2,7 м', '3 м'),
  'Расположение на этаже', 'Угловая', 'Лифт', 'Есть', 'Номер дома', cast(k % 50 as string), 'Двор', 'Закрытый',
  'Парковка', 'Подземная', 'Детская площадка', if(k % 7 = 0, 'Нет', 'Да'), 'Стены', 'Кирпичный', 'История цены', 'Лифт', 'Нет')"""


@query("card_rows_full", sql=f"""
SELECT {LID} AS listing_id, l_returnflag AS source_group, {dict(LISTING_EXPRS)['link']} AS link,
       CAST((2 + k % 9) * 1000000 + k % 1000 * 1000 AS BIGINT) AS price, CAST(20 + k % 90 AS DOUBLE) + 0.5e0 AS area_total,
       CAST(CASE WHEN k % 5 <> 0 THEN 1 + k % 4 WHEN k % 2 = 1 THEN 2 END AS INTEGER) AS rooms,
       CAST(1 + k % 9 AS INTEGER) AS floor, CAST(9 + k % 9 AS INTEGER) AS floors_total,
       CASE WHEN k % 2 = 0 THEN 'Москва, ул. Тестовая, ' || CAST(k % 100 AS VARCHAR) ELSE '2-комн. квартира, Москва, 5 этаж' END AS address,
       CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
       CASE WHEN k % 15 < k % 20 THEN 'Станция-Б' ELSE 'Станция А' END AS metro,
       CAST(1 + least(k % 15, k % 20) AS INTEGER) AS metro_walk_min, CAST(5 + k % 10 AS DOUBLE) AS kitchen_area,
       'Евро' AS renovation, 'Панельный' AS walls, CAST(1950 + k % 70 AS INTEGER) AS build_year,
       CASE WHEN k % 2 = 0 THEN 2.7e0 ELSE 3e0 END AS ceiling_height, 'Угловая' AS floor_position, 'Есть' AS elevator,
       CAST(k % 50 AS VARCHAR) AS house_number, 'Закрытый' AS yard, 'Подземная' AS parking,
       CASE WHEN k % 7 = 0 THEN 'Нет' ELSE 'Да' END AS playground
FROM {_LI}""")
def q_card_rows_full(spark, sf_dir):
    """L13 with all 14 labels of L6, several stations (L10, F24) and the second forms of L3, L7, L8, L9."""
    return E.card_rows(X.cards(spark, sf_dir, _FULL_CARD_TEXT))


_PRICE_TEXT = ("concat(CASE WHEN k % 2 = 0 THEN replace(format_number(price_i, 0), ',', ' ') "
               "ELSE concat('Стоимость ', replace(format_number(price_i, 0), ',', ' '), ' руб.') END, "
               "chr(10), 'Звоните 12 34')")


@query("price_coords", sql=f"""
SELECT {LID} AS listing_id, CAST(round(l_extendedprice * 1000) AS BIGINT) AS price,
       round(55.55e0 + (k % 4001) / 1e4, 6) AS latitude,
       round(37.35e0 + (k % 5003) / 1e4, 6) AS longitude FROM {_LI}""")
def q_price_coords(spark, sf_dir):
    """L3 price (whole digit line, or 'N руб') and L4 coordinates (first pair in range,
    after a decoy pair out of range) from page text / HTML built per listing."""
    li = _k_lineitem(spark, sf_dir).withColumn(
        "price_i", F.round(F.col("l_extendedprice") * 1000).cast("bigint"))
    text = F.expr(_PRICE_TEXT)
    lat = F.expr("55.55e0 + (k % 4001) / 1e4")
    lon = F.expr("37.35e0 + (k % 5003) / 1e4")
    html = F.concat(F.lit('<div data-a="61.12345, 39.12345"></div><div data-c="'),
                    F.format_string("%.6f", lat), F.lit(", "), F.format_string("%.6f", lon),
                    F.lit('"></div>'))
    t = li.select("listing_id", text.alias("text"), html.alias("html")).withColumn(
        "_normal", E.normal_text(F.col("text")))
    c = E.extract_coords(F.col("html"))
    return t.select("listing_id", E.extract_price(F.col("text"), F.col("_normal")).alias("price"),
                    c["latitude"].alias("latitude"), c["longitude"].alias("longitude"))


@query("card_fields_old", sql=f"""
SELECT {LID} AS listing_id, l_quantity * 3e0 AS area_total, CAST(NULL AS DOUBLE) AS kitchen_area,
       'x' AS walls, 'Станция' AS metro, CAST(1 + k % 40 AS INTEGER) AS metro_walk_min FROM {_LI}""")
def q_card_fields_old(spark, sf_dir):
    """L11 + L12: old-layout extractors - area (text or label), kitchen and walls (the
    last label wins, so the trailing 'Стены / x' is taken), metro from short blocks
    (pairs of consecutive lines stand in for nested page blocks)."""
    c = X.cards(spark, sf_dir).select("listing_id", "text", E.normal_text(F.col("text")).alias("normal")).withColumns(
        {"lines": E.split_lines(F.col("normal")), "low": E.split_lines(F.lower("normal"))})
    # only pairs that speak of minutes are joined: the extractor looks at no others
    timed = F.filter(F.sequence(F.lit(0), F.greatest(F.size("lines") - 2, F.lit(0))),
                     lambda i: F.get("lines", i).contains("мин") | F.coalesce(F.get("lines", i + 1).contains("мин"), F.lit(False)))
    blocks = F.transform(timed, lambda i: F.concat_ws(" ", F.get("lines", i), F.get("lines", i + 1)))
    m = E.metro_from_blocks(blocks)
    return c.select(
        "listing_id", E.total_area_old(F.col("text"), F.col("lines"), F.col("low")).alias("area_total"),
        to_float_first(E.last_value_after(F.col("lines"), "площадь кухни", F.col("low"))).alias("kitchen_area"),
        E.last_value_after(F.col("lines"), "стены", F.col("low")).alias("walls"),
        m["station"].alias("metro"), m["minutes"].alias("metro_walk_min"))


# ------------------------------------------------------------------ address / metro text
_ADDR = ("concat(CASE k % 4 WHEN 0 THEN 'На карте ' WHEN 1 THEN '3к, 97.4м², 10/12 этаж, ' "
         "ELSE '' END, 'Москва, ул. Тестовая, ', cast(k % 100 as string), "
         "CASE k % 3 WHEN 0 THEN ', квартира' WHEN 1 THEN ' Показать телефон +7 900' ELSE '' END)")
_ADDR_TRUTH = ("CASE WHEN k % 10 = 0 THEN NULL ELSE 'Москва, ул. Тестовая, ' || "
               "CAST(k % 100 AS VARCHAR) END")


def _addr_frame(spark, sf_dir):
    li = _k_lineitem(spark, sf_dir)
    txt = F.when(F.col("k") % 10 == 0, F.concat(F.lit("Посмотреть "), (F.col("k") % 30).cast("string"),
                                                F.lit(" фото"))).otherwise(F.expr(_ADDR))
    return li.select("listing_id", txt.alias("address_raw"))


@query("clean_address", sql=f"SELECT {LID} AS listing_id, {_ADDR_TRUTH} AS address FROM {_LI}")
def q_clean_address(spark, sf_dir):
    """C14 (script rules) + B7: photo junk -> NULL, map / room-area-floor prefixes and
    flat / phone tails removed."""
    a = _addr_frame(spark, sf_dir)
    return a.select("listing_id", T.clean_address(F.col("address_raw")).alias("address"))


@query("clean_address_notebook", sql=f"SELECT {LID} AS listing_id, {_ADDR_TRUTH} AS address FROM {_LI}")
def q_clean_address_notebook(spark, sf_dir):
    """C14 (notebook rules: photo junk anywhere, exact junk set, whitespace re-collapsed)."""
    a = _addr_frame(spark, sf_dir)
    return a.select("listing_id", T.clean_address(F.col("address_raw"), "notebook").alias("address"))


_METRO = ("CASE k % 5 WHEN 0 THEN 'Верхние Лихоборы Бибирево' WHEN 1 THEN 'Театральная  Чеховская Охотный' "
          "WHEN 2 THEN 'На карте Павелецкая' WHEN 3 THEN 'Ипотека' ELSE 'Ок' END")
_METRO_TRUTH = ("CASE k % 5 WHEN 0 THEN 'Верхние Лихоборы' WHEN 1 THEN 'Театральная' "
                "WHEN 2 THEN 'Павелецкая' ELSE NULL END")


@query("clean_metro_rule", sql=f"SELECT {LID} AS listing_id, {_METRO_TRUTH} AS metro FROM {_LI}")
def q_clean_metro_rule(spark, sf_dir):
    """Glued station strings -> first (known two-word) station; junk and too short
    names -> NULL."""
    li = _k_lineitem(spark, sf_dir)
    return li.select("listing_id", T.clean_metro_rule(F.expr(_METRO)).alias("metro"))


# ------------------------------------------------------------------ white-list (pages)
def whitelist(pages: DataFrame) -> DataFrame:
    """C17: distinct station-like tokens of all pages."""
    return E.whitelist_tokens(pages.select("html"), "html", "_t").select(F.explode("_t").alias("station")).distinct()


def match_whitelist(texts: DataFrame, wl: DataFrame, id_col: str, text_col: str,
                    max_n: int = 4) -> DataFrame:
    """C16 + E8: exact white-list hit, else the longest n-gram (n = 4..1, leftmost first)
    of the cleaned text found in the white-list. Candidates are exploded per text and
    semi-joined on the station name; the winner is an aggregate (min of (priority, pos))."""
    cand = texts.select(id_col, T.metro_candidate_text(F.col(text_col)).alias("_t"))
    cand = cand.where(F.col("_t").isNotNull()).withColumn("_w", F.split("_t", " "))
    full = cand.select(id_col, F.lit(0).alias("_prio"), F.lit(0).alias("_pos"),
                       F.col("_t").alias("station"))
    grams = cand.select(id_col, "_w", F.explode(F.sequence(F.lit(1), F.lit(max_n))).alias("_n")) \
        .where(F.col("_n") <= F.size("_w")) \
        .select(id_col, "_w", "_n", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1))
                .alias("_pos")) \
        .select(id_col, (F.lit(max_n + 1) - F.col("_n")).alias("_prio"), "_pos",
                F.array_join(F.slice("_w", F.col("_pos"), F.col("_n")), " ").alias("station"))
    allc = full.unionByName(grams).join(wl, "station", "left_semi")
    best = allc.groupBy(id_col).agg(F.min(F.struct("_prio", "_pos", "station")).alias("_b"))
    return texts.select(id_col).join(best, id_col, "left").select(
        id_col, F.col("_b")["station"].alias("metro"))


# Elements of each kind on their own: the generated pages hold no list inside a list.
_WL_SQL = """
, body AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g') AS html FROM pages),
raw AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1)) AS t FROM body
        UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1)) AS t FROM body),
norm AS (SELECT page_id, replace(replace(trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 'ё', 'е'), 'Ё', 'Е') AS station FROM raw),
wl AS (SELECT DISTINCT station FROM norm WHERE length(station) BETWEEN 3 AND 40
       AND station NOT IN ('А','Б','В','Г','Д','Е','Ж','З','И','Й','К','Л','М','Н','О','П','Р','С','Т','У','Ф','Х','Ц','Ч','Ш','Щ','Э','Ю','Я')
       AND NOT (lower(station) LIKE '%список%' OR lower(station) LIKE '%станции метро москвы%'
                OR lower(station) LIKE '%по алфавиту%' OR lower(station) LIKE '%главная%' OR lower(station) LIKE '%меню%'))"""


@query("whitelist_build", sql="WITH pages_ AS (SELECT 1) " + _WL_SQL + " SELECT station FROM wl")
def q_whitelist_build(spark, sf_dir):
    """C17: station white-list built from <li>/<a> texts of the pages table."""
    return whitelist(read_table(spark, sf_dir, "pages"))


@query("clean_metro_whitelist", sql="WITH pages_ AS (SELECT 1) " + _WL_SQL + """
, h1 AS (SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title FROM pages),
c AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        trim(regexp_replace(title, '\\s+', ' ', 'g')),
        '(?i)\\(\\s*\\d+(?:[.,]\\d+)?\\s*км\\s*\\)', '', 'g'),
        '(?i)^На карте\\s+', ''), '[^\\p{L}\\p{N}_\\sА-Яа-яЁё\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS t0
      FROM h1),
c2 AS (SELECT page_id, replace(replace(t0, 'ё', 'е'), 'Ё', 'Е') AS t FROM c
       WHERE t0 <> '' AND lower(t0) NOT IN ('в','до','метро','до метро','на карте','карта','всего','показать телефон','ипотека')
         AND lower(t0) NOT LIKE '%до метро%'),
w AS (SELECT page_id, t, string_split(t, ' ') AS words FROM c2),
g0 AS (SELECT page_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos
       FROM w, range(1, 5) r(n) WHERE n <= len(words)),
g AS (SELECT page_id, 0 AS prio, 0 AS pos, t AS station FROM w
      UNION ALL
      SELECT page_id, 5 - n AS prio, pos, array_to_string(words[pos:pos + n - 1], ' ') AS station FROM g0),
best AS (SELECT page_id, station AS metro FROM g WHERE station IN (SELECT station FROM wl)
         QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY prio, pos) = 1)
SELECT p.page_id, best.metro FROM pages p LEFT JOIN best USING (page_id)""")
def q_clean_metro_whitelist(spark, sf_dir):
    """C16 + E8: page titles matched against the white-list (exact, else longest n-gram,
    leftmost)."""
    pages = read_table(spark, sf_dir, "pages")
    titles = pages.select("page_id", F.regexp_extract("html", r"<h1>(.*?)</h1>", 1).alias("title"))
    return match_whitelist(titles, whitelist(pages), "page_id", "title")


@query("page_links", sql="""
WITH h AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base,
             regexp_extract_all(html, 'href\\s*=\\s*["'']([^"'']*)["'']', 1) AS hrefs FROM pages),
x AS (SELECT page_id, base, split_part(unnest(hrefs), '?', 1) AS href FROM h)
SELECT DISTINCT page_id, CASE WHEN starts_with(href, 'http') THEN href ELSE base || href END AS link
FROM x WHERE regexp_matches(href, '^/[^/]+/?$')""")
def q_page_links(spark, sf_dir):
    """L1: link list pages -> absolute single-segment links (the site pattern is a
    parameter; the default is the listing path '/realty/<digits>/')."""
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(E.page_links(F.col("html"), F.col("url"),
                                                      r"^/[^/]+/?$")).alias("link"))


@query("old_card_forms", sql=oracle_with("listings") + """
, c AS (SELECT listing_id, floor, floors_total, rooms, walls FROM listings)
SELECT listing_id,
       CASE WHEN floor IS NOT NULL AND floors_total IS NOT NULL THEN floor END AS floor,
       CASE WHEN floor IS NOT NULL AND floors_total IS NOT NULL THEN floors_total END AS floors_total,
       CASE WHEN rooms IS NULL THEN NULL WHEN rooms = 0 THEN 'Посёлок Новый' WHEN rooms < 4 THEN 'Тула, УЛ. Мира, ' || CAST(rooms AS VARCHAR)
            ELSE 'Лесной проезд, ' || CAST(rooms AS VARCHAR) END AS address
FROM c""")
def q_old_card_forms(spark, sf_dir):
    """L7 + L9, old cards: 'N/M этаж' anywhere in the text, the first line with a street marker."""
    l = X.listings(spark, sf_dir)
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    street = (F.when(F.col("rooms") == 0, "Посёлок Новый").when(F.col("rooms") < 4, say("Тула, УЛ. Мира, ", F.col("rooms").cast("string")))
              .when(F.col("rooms").isNotNull(), say("Лесной проезд, ", F.col("rooms").cast("string"))).otherwise("Квартира в центре"))
    floors = F.coalesce(say(F.col("floor").cast("string"), " / ", F.col("floors_total").cast("string"), " ЭТАЖ"), F.lit("этаж не указан"))
    cards = l.select("listing_id", say("Продажа\n", street, "\nшоссе рядом\n").alias("head"), floors.alias("floors"))
    cards = cards.withColumn("text", F.when(F.col("head").contains("Квартира"), say("Продажа\nКвартира в центре\n", F.col("floors")))
                             .otherwise(F.concat("head", "floors")))
    floor, total = E.floor_pair_old(F.col("text"))
    return cards.select("listing_id", floor.alias("floor"), total.alias("floors_total"),
                        E.address_line_old(E.text_lines(F.col("text"))).alias("address"))
