"""Column functions on strings. Null texts give null, or an empty array, unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that must equal the reference's for right results.
MENTION = r"@(\w+)"
TICKER = r"\b([A-Z]{2,6}(?:USDT|USD|BTC|ETH)?)\b|\$([A-Z]{2,6})"
URL = r"https?://[^\s<>\"{}|\\^`\[\]]+"
DATE = r"\b(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})\b"
TIME = r"\b(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AP]M)?)\b"
NUMBER = r"\b(\d+(?:[.,]\d+)?)\s*([%$€₽¥£]|USD|EUR|RUB|TON|BTC|ETH)?\b"
FILE = r"\b[\w\-]+\.(jpg|jpeg|png|gif|pdf|doc|docx|xls|xlsx|zip|rar|mp4|mp3|wav)\b"
CRYPTO = {"bitcoin": r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", "ethereum": r"\b0x[a-fA-F0-9]{40}\b", "ton": r"\bUQ[a-zA-Z0-9_-]{47}\b"}
TELEGRAM = {"channels": r"@(\w+)", "bots": r"@(\w+bot)\b", "groups": r"t\.me/(\w+)"}
DATE_FORMATS = ("dd.MM.yyyy", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy.MM.dd", "yyyy-MM-dd", "yyyy/MM/dd")
SERVICE_ACTIONS = ("invite_members", "remove_members", "pin_message", "create_group", "migrate_to_supergroup", "phone_call")
SERVICE_TEXTS = (r"^joined the (group|channel)$", r"^left the (group|channel)$", r"^pinned a message$", r"changed the (group|channel) (photo|title|description)")
SPAM_TEXTS = (
    r"Вы получили \d+ звёзд", r"You received \d+ stars", r"^\/start$", r"^\/help$", r"🎁 Новый подарок получен", r"🎁 New gift received", r"^Подарок отправлен$", r"^Gift sent$",
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
EMOJI = "[\U0001f1e0-\U0001f6ff\U0001f300-\U0001f5ff\U0001f900-\U0001f9ff\U0001fa70-\U0001faff\U00002700-\U000027bf]"


def extract_all(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(("(?i)" if ignore_case else "") + pattern), F.lit(group)), F.array().cast("array<string>"))


def distinct_first(items: Column) -> Column:
    """Without repeats, whatever their case; the first spelling stays, in order."""
    return F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def normalize(text: Column) -> Column:
    """Without tags, [date:] and [source:] marks, emoji and runs of white space; case stays. The named HTML entities are read first.

    Empty for null.
    """
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, F.coalesce(text, F.lit("")))
    for pattern, to in ((r"<[^>]+>", ""), (r"(?i)\[(?:source|date):[^\]]*\]", ""), (EMOJI, ""), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def tokens(text: Column) -> Column:
    """Normalised text split on spaces, case kept; none for an empty text."""
    return F.array_remove(F.split(normalize(text), " "), "")


def mentions(text: Column) -> Column:
    return distinct_first(extract_all(text, MENTION, 1))


def tickers(text: Column, known: list[str]) -> Column:
    """Upper-case words and $-marked ones that are known as they are or without a quote currency."""
    found = F.zip_with(extract_all(text, TICKER, 1), extract_all(text, TICKER, 2), lambda a, b: F.when(a != "", a).otherwise(b))
    base = lambda x: reduce(lambda t, q: F.replace(t, F.lit(q), F.lit("")), ("USDT", "USD", "BTC", "ETH"), x)
    return F.array_distinct(F.filter(found, lambda x: (x != "") & (base(x).isin(known) | x.isin(known))))


def urls(text: Column) -> Column:
    return F.array_distinct(extract_all(text, URL))


def domains(urls_: Column) -> Column:
    """Hosts with their ports, each once."""
    return F.array_distinct(F.filter(F.transform(urls_, lambda u: F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), lambda x: x != ""))


def dates(text: Column) -> Column:
    """Dates as yyyy-MM-dd, each once; what no format reads is left out."""
    read = lambda x: F.coalesce(*(F.date_format(F.try_to_timestamp(x, F.lit(f.replace("dd", "d").replace("MM", "M"))), "yyyy-MM-dd") for f in DATE_FORMATS))
    return F.array_distinct(F.array_compact(F.transform(extract_all(text, DATE, 1), read)))


def times(text: Column) -> Column:
    return F.array_distinct(extract_all(text, TIME, 1, True))


def numbers(text: Column) -> Column:
    """(value, original, unit or null) of each number."""
    made = lambda o, u: F.struct(F.replace(o, F.lit(","), F.lit(".")).cast("double").alias("value"), o.alias("original"), F.when(u != "", u).alias("unit"))
    return F.zip_with(extract_all(text, NUMBER, 1, True), extract_all(text, NUMBER, 2, True), made)


def files(text: Column) -> Column:
    return F.array_distinct(extract_all(text, FILE, 0, True))


def crypto_addresses(text: Column) -> Column:
    """(type, address, network), by type and then place."""
    return F.flatten(F.array(*(F.transform(extract_all(text, p, 0, True), _typed(k)) for k, p in CRYPTO.items())))


def _typed(kind: str):  # noqa: ANN202  (a function of a Column)
    return lambda x: F.struct(F.lit(kind).alias("type"), x.alias("address"), F.lit(kind.upper()).alias("network"))


def telegram(text: Column) -> Column:
    """(channels, bots, groups), each an array without repeats."""
    return F.struct(*(F.array_distinct(extract_all(text, p, 1, True)).alias(k) for k, p in TELEGRAM.items()))


def language(text: Column) -> Column:
    """ru for more Cyrillic than Latin letters, en for any Latin letter, else null."""
    latin, cyrillic = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[А-Яа-яЁё]"))
    return F.when(cyrillic > latin, "ru").when(latin > 0, "en")


def slug(text: Column, default: str = "unnamed") -> Column:
    """Lower-case letters and digits with underscores for all else; accents go and Cyrillic letters are spelled out."""
    plain = F.translate(F.lower(text), "áàâäãåçéèêëíìîïñóòôöõúùûüýÿабвгдеёзийклмнопрстуфхцыэ", "aaaaaaceeeeiiiinooooouuuuyyabvgdeeziiklmnoprstufhcye")
    for a, b in (("ж", "zh"), ("ч", "ch"), ("ш", "sh"), ("щ", "sch"), ("ъ", ""), ("ь", ""), ("ю", "yu"), ("я", "ya"), ("ß", "")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    made = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(made, F.lit("")) == "", default).otherwise(made)


def clean_url(url: Column) -> Column:
    """Trimmed; with https:// where only the scheme is missing; null for what is no address."""
    u = F.trim(url)
    host = r"^[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+(?::\d+)?(?:[/?#].*)?$"
    return F.when(u.rlike(r"^https?://(?:\[[0-9A-Fa-f:.]+\]|[^\s/\[\]]+)(?:[/?#]\S*)?$"), u).when(u.rlike(host), F.concat(F.lit("https://"), u))


def truncate(text: Column, most: int, suffix: str = "...") -> Column:
    """Cut to `most` characters, of which the suffix is part."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - len(suffix))), F.lit(suffix)))


def word_set(text: Column) -> Column:
    return F.array_distinct(extract_all(F.lower(text), r"[\p{L}\p{N}_]+"))


def relevance(text: Column, query: str) -> Column:
    """0.6 times the share of the query's words that occur, 0.4 times their density, doubled for the exact phrase; at most 1."""
    words = sorted(set(query.lower().split()))
    low = F.lower(text)
    own = word_set(text)
    hit = F.size(F.array_intersect(own, F.array(*map(F.lit, words))))
    count = sum((((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)) for w in words), F.lit(0))
    density = F.least(count / F.greatest(F.size(own), F.lit(1)), F.lit(1.0))
    score = (hit / len(words) * 0.6 + density * 0.4) * F.when(low.contains(query.lower()), 2.0).otherwise(1.0)
    return F.when(hit == 0, 0.0).otherwise(F.least(score, F.lit(1.0)))


def snippet(text: Column, query: str, most: int = 200) -> Column:
    """So many characters around the first of the query's words, with its words marked **so**; the beginning if there is none."""
    words = [w for w in query.lower().split() if w]
    at = F.least(*(F.nullif(F.locate(w, F.lower(text)), F.lit(0)) for w in words), F.lit(1 << 30))
    start = F.when(at == 1 << 30, 1).otherwise(F.greatest(F.lit(1), at - most // 2))
    return F.regexp_replace(F.substring(text, start, F.lit(most)), "(?i)(" + "|".join(map(_escaped, words)) + ")", "**$1**")


def _escaped(word: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in word)


def is_service(action: Column, text: Column) -> Column:
    return F.coalesce(action.isin(*SERVICE_ACTIONS), F.lit(False)) | F.coalesce(reduce(lambda a, b: a | b, (text.rlike(f"(?i){p}") for p in SERVICE_TEXTS)), F.lit(False))


def is_bot_spam(username: Column, text: Column) -> Column:
    """Notices of bots by their wording; or short marks and figures from a name that ends with bot."""
    known = reduce(lambda a, b: a | b, (text.rlike(f"(?i){p}") for p in SPAM_TEXTS))
    short = F.lower(username).endswith("bot") & (F.length(F.trim(text)) < 50) & (text.startswith("✅") | text.startswith("❌") | text.startswith("⚠️") | text.rlike(r"^[\d\s.,+\-*/=()]+$"))
    return F.coalesce(known, F.lit(False)) | F.coalesce(short, F.lit(False))


def is_empty(text: Column, file: Column, media: Column) -> Column:
    return (F.trim(F.coalesce(text, F.lit(""))) == "") & file.isNull() & media.isNull()


def pattern_bonus(text: Column) -> Column:
    """Importance of marks in a text, at most 0.3: links, mentions, hash tags, questions, code, figures, many words."""
    text = F.coalesce(text, F.lit(""))
    n = lambda p: F.regexp_count(text, F.lit(p))
    words = F.size(extract_all(text, r"[\p{L}\p{N}_]+"))
    parts = (
        F.when(text.rlike("https?://"), 0.05), F.least(n(r"@\w+") * 0.02, F.lit(0.1)), F.least(n(r"#\w+") * 0.02, F.lit(0.1)), F.when(text.contains("?"), 0.03),
        F.when(text.contains("```") | (n(r"\{") > 3) | (n(r"\(") > 5), 0.05), F.when(n(r"\d+") > 3, 0.03), F.when(words > 10, F.least(words / 100, F.lit(0.1))),
    )
    return F.least(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), F.lit(0.3))


def importance(text: Column, n_entities: Column, has_task: Column, search_hits: Column) -> Column:
    """0 to 1: a tenth an entity up to a half, 0.3 for a task, 0.2 above 500 characters (half above 200), up to 0.4 for ten search hits, and marks."""
    size = F.length(F.coalesce(text, F.lit("")))
    total = F.least(n_entities * 0.1, F.lit(0.5)) + F.when(has_task, 0.3).otherwise(0.0) + F.when(size > 500, 0.2).when(size > 200, 0.1).otherwise(0.0)
    return F.least(total + F.least(search_hits / 10, F.lit(1.0)) * 0.4 + pattern_bonus(text), F.lit(1.0))


def estimated_tokens(text: Column, rate: float = 0.25, has_media: Column | None = None) -> Column:
    """Characters times a rate, 5 for the author, 20 for media."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) * rate) + 5 + (F.when(has_media, 20).otherwise(0) if has_media is not None else 0)


def hash_embedding(tokens_: Column, dim: int = 64) -> Column:
    """Bag of words: each token counts at md5(token) modulo `dim`, scaled to length 1. `dim` must be a power of 2, or 384."""
    if dim == 384:  # 384 = 128 * 3: the remainders by both make up the one
        hexes = lambda t: F.transform(F.split(F.md5(t.cast("binary")), ""), lambda c: F.conv(c, 16, 10).cast("int"))
        low = lambda t: F.conv(F.right(F.md5(t.cast("binary")), F.lit(2)), 16, 10).cast("int") % 128
        three = lambda t: F.aggregate(F.filter(hexes(t), lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 3
        place = lambda t: (low(t) * 129 + three(t) * 256) % 384
    else:
        place = lambda t: F.pmod(F.conv(F.right(F.md5(t.cast("binary")), F.lit(15)), 16, 10).cast("long"), F.lit(dim)).cast("int")
    # each step is bound before it is used in a loop, so that it is evaluated once a row
    counts = let(F.transform(tokens_, place), lambda at: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(at, lambda x: x == k)).cast("double")))
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    return let(counts, lambda c: let(length(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Common Russian and English words that carry little meaning.
STOP_WORDS = ("и", "в", "не", "на", "что", "с", "по", "это", "как", "а", "то", "из", "у", "за", "к", "the", "a", "an", "and", "or", "of", "to", "in", "is", "it", "that")


#: Signs and words of currencies, and words of large numbers.
CURRENCIES = (("USD", r"\$", "usd|доллар(?:ов)?|бакс(?:ов)?"), ("EUR", "€", "eur|евро"), ("RUB", "₽", r"rub|руб(?:ля|лей)?\.?|р\."))
SCALES = (("BILLION", "млрд|миллиард(?:а|ов)?"), ("MILLION", "млн|миллион(?:а|ов)?"), ("THOUSAND", "тыс|тысяч(?:а|и)?"))


def rewrite_numbers(text: Column) -> Column:
    """Amounts as a kind and a value: MONEY_USD AMOUNT_x, BILLION, MILLION and THOUSAND VALUE_x, PERCENTAGE VALUE_x.

    Commas between digits go; before a currency's word blanks go too, and an only comma without a point is a decimal one. A currency's or
    number's word ends where its letters end, and the amount begins at a digit.
    """
    whole, decimal, end = "\x01", "\x02", "\x03"  # around values that are still to be cleaned
    for code, sign, _ in CURRENCIES:
        text = F.regexp_replace(text, sign + r"([\d,]+(?:\.\d{2})?)", f"MONEY_{code} AMOUNT_{whole}$1{end}")
    for code, _, words in CURRENCIES:
        text = F.regexp_replace(text, rf"(?iu)(?<![_\d{whole}{decimal}])(\d[\d\s\u00a0,.]*?)[\s\u00a0]*(?:{words})(?![a-zа-яё])", f"MONEY_{code} AMOUNT_{decimal}$1{end}")
    number = r"(?<![_\d,.\x01\x02])(\d[\d,]*(?:\.\d+)?)\s*"
    for name, words in SCALES:
        text = F.regexp_replace(text, rf"(?iu){number}(?:{words})(?![a-zа-яё])", f"{name} VALUE_{whole}$1{end}")
    text = F.regexp_replace(text, f"{number}%", f"PERCENTAGE VALUE_{whole}$1{end}")
    for pattern, to in (
        (rf"(?<={decimal}[\d\s\u00a0,.]{{0,60}})[\s\u00a0]", ""), (rf"{decimal}(\d+),(\d+){end}", f"{whole}$1.$2{end}"),
        (rf"(?<=[{whole}{decimal}][\d,.]{{0,60}}),", ""), (f"[{whole}{decimal}{end}]", ""),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def word_tokens(text: Column, least: int = 3, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case tokens of a text with its amounts rewritten, of `least` characters or more and without stop words; a word's form stays as it is."""
    found = extract_all(F.lower(rewrite_numbers(text)), r"money_[a-z]+|(?:amount|value)_[a-z0-9.]+|[а-яё]+|[a-z]+|\d+")
    return F.filter(found, lambda x: (F.length(x) >= least) & ~x.isin(*stop))


def with_variants(rows: DataFrame, forms: DataFrame, tokens: str) -> DataFrame:
    """Adds variants: the distinct tokens of a row and their dictionary forms. `forms` has (word, form); words without one stay alone."""
    each = rows.select(F.monotonically_increasing_id().alias("__tm_id"), "*")
    words = each.select("__tm_id", F.explode(F.array_distinct(tokens)).alias("word"))
    found = words.join(forms.select("word", "form").distinct(), "word", "left").select("__tm_id", F.explode(F.array_compact(F.array("word", "form"))).alias("v"))
    sets = found.groupBy("__tm_id").agg(F.array_sort(F.collect_set("v")).alias("variants"))
    return each.join(sets, "__tm_id", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<string>"))).drop("__tm_id")


def named_entities(rows: DataFrame, gazetteer: DataFrame, id_col: str, tokens: str, longest: int = 4) -> DataFrame:
    """(id_col, kind, name, n): how often names of a gazetteer (name: lower-case words joined by blanks, kind) occur in a row's tokens.

    Runs of up to `longest` tokens are looked up; a name within a longer one counts as well.
    """
    size = F.size(tokens)

    def runs_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), size - n), lambda k: F.array_join(F.slice(tokens, k + 1, n), " "))

    runs = [runs_of(n) for n in range(1, longest + 1)]
    every = F.flatten(F.array(*(F.when(size >= n, r).otherwise(F.array().cast("array<string>")) for n, r in enumerate(runs, 1))))
    found = rows.select(id_col, F.explode(every).alias("name")).join(gazetteer.select("name", "kind").distinct(), "name")
    return found.groupBy(id_col, "kind", "name").agg(F.count("*").alias("n"))

