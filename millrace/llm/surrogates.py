"""Surrogates for personal data: every detected entity gets a keyed replacement of its own kind and form.

Only DataFrame functions are used. An entity's replacement is a function of the key, its kind and its
canonical form (an e-mail address in lower case, a phone number's national digits, ...), so the same
entity has the same replacement in every text and in every way of writing it; the replacement is then
put into the form at hand: separators, letter case and length stay. Kinds: e-mail addresses (the local
part and host labels change, the domain becomes one reserved for examples), phone numbers (the country
code stays), IPv4 addresses (valid octets), payment card numbers (brand digit stays, Luhn sum holds),
social security numbers, secrets behind an assignment (alphabet stays), and names behind a title or
with a known first name: first names change within their gender and script, surnames within their script.

Distinct entities must get distinct replacements, and none may be another entity of the corpus. All
distinct entities are checked against both; those in conflict, but for the smallest of equals, try
again with the next attempt number, until none is in conflict. Short phone numbers, of which a corpus may
hold every one, grow by a group of digits then; what is in conflict after all attempts becomes a tag of
its kind and keyed hash. Replacements are computed in place; only
attempts other than the first are looked up, as a literal map, or by a join if there are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, prepare, spare, stored

# Titles and first names by gender and script.
MALE_TITLES = ("Mr", "Herr", "Señor", "Monsieur", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа")
OTHER_TITLES = ("Dr", "Prof")
FIRST_NAMES = {
    ("f", "latin"): ("Alice", "Anna", "Carmen", "Catherine", "Charlotte", "Claire", "Elizabeth", "Emily", "Emma", "Helen", "Isabel", "Julia", "Laura", "Margaret", "Maria", "Marie", "Martha", "Mary", "Patricia", "Sarah", "Sophie", "Susan", "Ursula"),
    ("m", "latin"): ("Albert", "Andrew", "Carlos", "Charles", "Daniel", "David", "Edward", "Frank", "George", "Hans", "Henry", "James", "Jean", "John", "José", "Michael", "Paul", "Peter", "Pierre", "Richard", "Robert", "Stefan", "Thomas", "William"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"),
    ("m", "cyrillic"): ("Александр", "Алексей", "Борис", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей"),
}
SYLLABLES = {
    "latin": ("bal", "ber", "bor", "cal", "cor", "dal", "dor", "fal", "fen", "gar", "hal", "har", "kel", "lan", "lor", "mar", "mel", "mon", "nel", "nor", "pel", "ral", "ros", "sal", "sel", "tan", "tor", "val", "ver", "wen", "wil", "zan"),
    "cyrillic": ("бал", "бер", "бор", "вал", "вел", "гор", "дан", "дор", "зар", "кал", "кор", "лан", "лев", "мар", "мел", "мор", "нел", "нор", "пал", "пел", "рад", "рал", "рос", "сал", "сел", "тал", "тор", "фед", "хар", "цел", "чер", "шал"),
}
EXAMPLE_ENDINGS = ("com", "net", "org")

_names = "|".join(n for names in FIRST_NAMES.values() for n in names)
_titles = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
_surname = r"\p{Lu}\p{L}+(?:[-'’]\p{Lu}\p{L}+)?"
_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Host names have labels of up to 63 characters, at most 127 of them: the bounds keep the pattern's recursion shallow.
_email = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]{1,63}+(?:\.[A-Za-z0-9\-]{1,63}){0,125}\.[A-Za-z]{2,63}"
_secret = r"(?<=[=:\"' \t])(?=[0-9A-Za-z_\-]{16})(?<=(?i:token|secret|api_key|apikey|password|passwd)[ \t]{0,3}[=:][ \t]{0,3}[\"']?)[0-9A-Za-z_\-]{16,}"
_numbers = "(?=[0-9+(])(?:" + "|".join(
    [
        rf"(?<![\w.+\-]){_octet}(?:\.{_octet}){{3}}(?!\.?\w)",
        r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
        r"(?<![\w\-])(?=\d(?:[ \-]?\d){12})(?!\d(?:-?\d){19}|[\d\-]*--)\d[\d \-]*\d(?![\w\-]|\.\d+\.\d)",
        r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w)",
        r"(?<![\w+])\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\w)",
        r"(?<![\w+.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])",
    ]
) + ")"
_starts = "".join(sorted({n[0] for n in f"{_names}|{_titles}".split("|")}))
_person = rf"(?=[{_starts}])(?<![\p{{L}}\p{{N}}])(?:(?:{_titles})\.? (?:(?:{_names}) )?|(?:{_names}) ){_surname}"
PATTERN = "|".join([_email, _secret, _numbers, _person])
KINDS = ("email", "secret", "ip", "ssn", "card", "phone", "name")
_TRIES = 30
#: A phone number with up to this many national digits gets `_MORE` digits in addition from attempt `_LONGER` on: a corpus may hold all short ones.
_SHORT, _MORE, _LONGER = 7, 6, 3


def _let(x: Column, f) -> Column:
    """f(x), with x evaluated once and named, so that expressions stay small."""
    return F.element_at(F.transform(F.array(x), lambda v: f(v)), 1)


def _chars(x: Column) -> Column:
    return F.split(x, "")


def _only(x: Column, keep: str) -> Column:
    return F.regexp_replace(x, f"[^{keep}]", "")


def _luhn_sum(digits: Column, offset: int) -> Column:
    """The Luhn sum of digits of which the last is `offset` places from the right end."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i + offset) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _is_card(x: Column) -> Column:
    return _let(_only(x, "0-9"), lambda digits: digits.rlike("^(?:[3-6]|2[2-7])") & (_luhn_sum(digits, 0) % 10 == 0))


_usual = r"^(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ \-])\d{6}\2\d{4,5})$"


def _inside(x: Column, usual: bool) -> Column:
    """A pattern of the entities in a row of numbers: cards in a usual grouping, longest first, or else a card in any grouping if it is the whole row (parts of any grouping would often have a right Luhn sum by chance), and other kinds."""
    if usual:
        some = [F.regexp_extract_all(x, F.lit(rf"(?<![\d\-])(?=(\d(?:[ \-]?\d){{{n - 1}}})(?![\d\-]))"), F.lit(1)) for n in range(19, 12, -1)]
        cards = F.filter(F.array_distinct(F.concat(*some)), lambda c: c.rlike(_usual) & _is_card(c))
    else:
        cards = F.filter(F.array(F.trim(x)), lambda c: c.rlike(r"^\d(?:[ \-]?\d){12,18}$") & _is_card(c))
    others = ["(?!)"] if usual else [r"\d{3}-\d{2}-\d{4}", r"\d{3}-\d{3}-\d{4}"]
    return F.concat(F.lit(r"(?<![\d\-])(?:"), F.array_join(F.concat(cards, F.array(*map(F.lit, others))), "|"), F.lit(r")(?![\d\-])"))


def _by_row(x: Column, f, g) -> Column:
    """The array of f(between, card or null) along the cards of x in a usual grouping; between is the array of g(text, entity or null) along the other entities there."""

    def at(y: Column, usual: bool, h) -> Column:
        return _let(_inside(y, usual), lambda p: F.zip_with(F.split(y, p, -1), F.regexp_extract_all(y, p, F.lit(0)), h))

    return at(x, True, lambda a, b: f(at(a, False, g), b))


def _in_row(x: Column) -> Column:
    """Whether a match is a row of numbers with blanks between."""
    return x.rlike(r"^\d[\d\-]* [\d \-]*$")


def parts(x: Column) -> Column:
    """The entities in a match: itself, or those in a row of numbers, where a card may stand behind or before others."""
    inside = _by_row(x, lambda some, b: F.concat(some, F.array(b)), lambda a, b: b)
    return F.when(_in_row(x), F.array_compact(F.flatten(inside))).otherwise(F.array(x))


def kind_of(x: Column) -> Column:
    """The kind of a part of a match of PATTERN (parts()); null for a number that only looks like one of a payment card."""
    return (
        F.when(x.contains("@"), "email")
        .when(x.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(x.rlike(r"^(?:\+|\(|\d{3}[.\-]\d{3}[.\-]\d{4}$)"), "phone")
        .when(x.rlike(r"^\d(?:[ \-]?\d){12,18}$"), F.when(_is_card(x), "card"))
        .when(x.rlike(r"^(?:[\d \-]* [\d \-]*|\d[\d\-]{0,14})$"), None)
        .when(x.contains(" "), "name")
        .otherwise("secret")
    )


def _country(x: Column) -> Column:
    """The country code of a phone number with a plus sign, else empty."""
    return F.regexp_extract(x, r"^\+(\d{1,3})(?=[ .(\-])", 1)


def canonical(x: Column, kind: Column) -> Column:
    digits = _only(x, "0-9")
    national = F.substr(digits, F.length(_country(x)) + 1)
    return F.when(kind == "email", F.lower(x)).when(kind == "phone", national).when(kind.isin("ssn", "card"), digits).when(kind == "surname", F.lower(x)).otherwise(x)


def _draw(secret: Column, i: Column) -> Column:
    """A number under 65536 for place i (from 0), from the hexadecimal digits of a keyed hash."""
    return F.conv(F.substr(secret, (i % 30) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _like(c: Column, n: Column) -> Column:
    """A character of the same class as c, chosen by n."""
    pick = lambda letters: F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))
    return F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)


def _alike(x: Column, secret: Column) -> Column:
    """Every letter and digit of x replaced by one of its class; hexadecimal strings stay so."""
    if_hex = lambda c, n: F.when(c.rlike("[0-9]"), F.substr(F.lit("0123456789"), n % 10 + 1, F.lit(1))).when(c.rlike("[a-z]"), F.substr(F.lit("abcdef"), n % 6 + 1, F.lit(1))).otherwise(F.substr(F.lit("ABCDEF"), n % 6 + 1, F.lit(1)))
    plain = F.transform(_chars(x), lambda c, i: _let(_draw(secret, i), lambda n: _like(c, n)))
    return F.array_join(F.when(x.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$"), F.transform(_chars(x), lambda c, i: _let(_draw(secret, i), lambda n: if_hex(c, n)))).otherwise(plain), "")


def replacement(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of an entity's replacement."""
    hashed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 512)
    return _let(hashed, lambda secret: _replacement(kind, canon, attempt, secret))


def _replacement(kind: Column, canon: Column, attempt: Column, secret: Column) -> Column:
    more = F.transform(F.sequence(F.lit(1), F.greatest(attempt - 1, F.lit(1))), lambda i: (_draw(secret, i + 20) % 10).cast("string"))
    spare = F.when(attempt >= 2, F.array_join(more, "")).otherwise("")
    kept = lambda labels: F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))), ".")
    hosts = _let(F.split(F.substring_index(canon, "@", -1), r"\."), lambda labels: F.when(F.size(labels) > 2, F.concat(_alike(kept(labels), F.reverse(secret)), F.lit("."))).otherwise(""))
    ending = _let(F.substring_index(canon, ".", -1), lambda e: F.when(e.isin(*EXAMPLE_ENDINGS), e).otherwise(EXAMPLE_ENDINGS[0]))
    email = F.concat(_alike(F.substring_index(canon, "@", 1), secret), spare, F.lit("@"), hosts, F.lit("example."), ending)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(secret, i) % F.when(i == 0, 223).otherwise(254) + 1).cast("string")), ".")
    drawn = F.transform(F.sequence(F.lit(1), F.greatest(F.length(canon) - 2, F.lit(1))), lambda i: (_draw(secret, i) % 10).cast("string"))
    card = _let(F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.array_join(drawn, "")), lambda body: F.concat(body, ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string")))

    def syllables(script: str) -> Column:
        parts = F.array(*map(F.lit, SYLLABLES[script]))
        return F.array_join(F.transform(F.sequence(F.lit(0), 2 + F.floor(attempt / 3).cast("int")), lambda i: F.element_at(parts, _draw(secret, i) % len(SYLLABLES[script]) + 1)), "")

    surname = F.when(_script(canon) == "cyrillic", syllables("cyrillic")).otherwise(syllables("latin"))
    tail = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(_MORE - 1)), lambda i: (_draw(secret, i + 16) % 10).cast("string")), "")
    longer = (kind == "phone") & (F.length(canon) <= _SHORT) & (attempt >= _LONGER)
    last = F.concat(F.lit("["), kind, F.lit("-"), F.substr(secret, F.lit(1), F.lit(32)), F.lit("]"))
    return F.when(attempt < 0, last).when(longer, F.concat(_alike(canon, secret), tail)).when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", card).when(kind == "surname", surname).otherwise(_alike(canon, secret))


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _in_form(x: Column, kind: Column, new: Column) -> Column:
    """A canonical replacement in the form of x: its separators, country code and letter case."""

    own = F.length(canonical(x, kind))  # the digits that change; more than these come behind, as a group of their own

    def digit(c: Column, i: Column) -> Column:
        behind = F.length(_only(F.substr(x, i + 2), "0-9"))
        return _let(behind, lambda n: F.when(c.rlike("[0-9]") & (n < own), F.substr(new, own - n, F.lit(1))).otherwise(c))

    numbers = F.concat(F.array_join(F.transform(_chars(x), digit), ""), F.when(F.length(new) > own, F.concat(F.lit(" "), F.substr(new, own + 1, F.lit(3)), F.lit(" "), F.substr(new, own + 4))).otherwise(""))
    cased = F.when(x == F.upper(x), F.upper(new)).when(x == F.lower(x), new).otherwise(F.initcap(new))
    mixed = F.array_join(F.zip_with(_chars(new), _chars(x), lambda c, old: F.when(old.rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    return F.when(new.startswith("["), new).when(kind.isin("phone", "ssn", "card"), numbers).when(kind == "surname", cased).when(kind == "email", mixed).otherwise(new)


def _first_name(x: Column, key: str) -> Column:
    """Another first name of the same gender and script, by a keyed rotation; null if x is none."""
    import hashlib

    out = F.lit(None).cast("string")
    for (gender, script), names in FIRST_NAMES.items():
        turn = 1 + int(hashlib.sha256(f"{key}|{gender}|{script}".encode()).hexdigest(), 16) % (len(names) - 1)
        table = F.create_map(*[F.lit(v) for k, n in enumerate(names) for v in (n, names[(k + turn) % len(names)])])
        out = F.when(x.isin(*names), F.element_at(table, x)).otherwise(out)
    return out


def _is_title(x: Column) -> Column:
    return F.regexp_replace(x, r"\.$", "").isin(*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)


def surrogate(x: Column, key: str, attempt) -> Column:
    """The replacement of a match; attempt(kind, canonical) gives the attempt number. Not an entity: x itself."""

    def one(kind: Column, y: Column) -> Column:
        return _let(canonical(y, kind), lambda canon: _let(replacement(kind, canon, attempt(kind, canon), key), lambda new: _in_form(y, kind, new)))

    def word(w: Column, i: Column) -> Column:
        return F.when(i == F.size(F.split(x, " ")) - 1, one(F.lit("surname"), w)).when(_is_title(w), w).otherwise(F.coalesce(_first_name(w, key), w))

    name = F.array_join(F.transform(F.split(x, " "), word), " ")
    whole = _let(kind_of(x), lambda kind: F.when(kind.isNull(), x).when(kind == "name", name).otherwise(one(kind, x)))

    new = lambda y: F.when(y.isNull(), "").otherwise(_let(kind_of(y), lambda kind: one(kind, y)))
    inside = _by_row(x, lambda some, b: F.concat(F.array_join(some, ""), new(b)), lambda a, b: F.concat(a, new(b)))
    return F.when(_in_row(x), F.array_join(inside, "")).otherwise(whole)


def matches(text: Column) -> Column:
    """All matches of PATTERN. Texts without an @ can have no address, and those without digits or assignments only names: shorter patterns find the same there."""
    found = lambda *parts: F.regexp_extract_all(text, F.lit("|".join(parts)), F.lit(0))
    return F.when(text.contains("@"), found(PATTERN)).when(text.rlike("[0-9=:]"), found(_secret, _numbers, _person)).otherwise(found(_person))


def entities(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, canon): all different entities, names by their surnames."""
    x = df.select(F.explode(F.flatten(F.transform(matches(F.col(f"`{text_col}`")), parts))).alias("x")).withColumn("kind", kind_of(F.col("x"))).where("kind is not null")
    named = F.col("kind") == "name"
    x = x.select(F.when(named, "surname").otherwise(F.col("kind")).alias("kind"), F.when(named, F.substring_index("x", " ", -1)).otherwise(F.col("x")).alias("x"))
    return x.select("kind", canonical(F.col("x"), F.col("kind")).alias("canon")).distinct()


def attempts(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first replacement is not free; attempt -1 for those that `_TRIES` of them left in conflict, which get a tag with their hash."""
    real = stored(found, "pii-entities")
    now = real.withColumn("attempt", F.lit(0))
    for _ in range(_TRIES):
        new = now.withColumn("new", replacement(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        shared = new.groupBy("kind", "new").agg(F.min("canon").alias("first"), F.count("*").alias("n"))
        taken = shared.join(real.select("kind", F.col("canon").alias("new"), F.lit(True).alias("is_real")), ["kind", "new"], "left").where("n > 1 or is_real")
        clash = new.join(taken, ["kind", "new"]).where("is_real or canon != first").select("kind", "canon")
        clash = checkpointed(clash)
        if clash.isEmpty():
            return now.where("attempt > 0")
        again = clash.withColumn("again", F.lit(1))
        now = checkpointed(now.join(again, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")))
    return now.select("kind", "canon", F.when(F.col("attempt") >= _TRIES, -1).otherwise(F.col("attempt")).alias("attempt")).where("attempt <> 0")


#: Attempt numbers of up to this many entities are looked up in a literal map.
LITERAL = 500


def _replaced(text: Column, found: Column, key: str, attempt) -> Column:
    new = F.transform(found, lambda x: surrogate(x, key, attempt))
    parts = F.zip_with(F.split(text, PATTERN, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", found_col: str = "pii_found") -> DataFrame:
    """df with text_col replaced, and found_col, the matches as they were, of a row of numbers its entities (null for a null text).

    Rows keep their other columns, but for one named found_col; repeated rows stay repeated and get the
    same replacements, as does every mention of an entity. Null texts stay null, empty ones empty; an empty
    table gives no rows. Very long texts are searched whole: every repeated part of the patterns is bounded
    or a single character class, so neither stack nor time grows faster than the text. Columns may have any
    names; those of temporary columns are chosen anew. Ties between entities in conflict go to the smaller one.
    """
    prepare(df.sparkSession)
    df = df.drop(found_col)
    text, found = F.col(f"`{text_col}`"), F.col(f"`{found_col}`")
    retry = stored(attempts(entities(df, text_col), key), "pii-attempts")
    docs = df.withColumn(found_col, matches(text))
    some = retry.limit(LITERAL + 1).collect()
    if len(some) <= LITERAL:
        table = F.create_map(*[F.lit(v) for r in some for v in (f"{r['kind']}|{r['canon']}", r["attempt"])]) if some else None
        attempt = lambda kind, canon: F.coalesce(table[F.concat(kind, F.lit("|"), canon)], F.lit(0)) if some else F.lit(0)
        return docs.withColumn(text_col, _replaced(text, found, key, attempt)).withColumn(found_col, F.flatten(F.transform(found, parts)))
    # many: the texts that hold such entities get their attempt numbers by a join
    name, tries = spare(docs, "text_sha"), spare(docs, "tries")
    sha = F.sha2(text.cast("binary"), 256)
    x = docs.select(sha.alias("sha"), F.explode(F.flatten(F.transform(found, parts))).alias("x")).withColumn("kind", kind_of(F.col("x"))).where("kind is not null")
    named = F.col("kind") == "name"
    x = x.select("sha", F.when(named, "surname").otherwise(F.col("kind")).alias("kind"), F.when(named, F.substring_index("x", " ", -1)).otherwise(F.col("x")).alias("x"))
    x = x.select("sha", "kind", canonical(F.col("x"), F.col("kind")).alias("canon")).distinct().join(retry, ["kind", "canon"])
    tables = x.groupBy(F.col("sha").alias(name)).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("|"), "canon"), "attempt"))).alias(tries))
    docs = docs.withColumn(name, F.when(F.size(found) > 0, sha)).join(tables, name, "left")
    attempt = lambda kind, canon: F.coalesce(F.col(f"`{tries}`")[F.concat(kind, F.lit("|"), canon)], F.lit(0))
    return docs.withColumn(text_col, _replaced(text, found, key, attempt)).withColumn(found_col, F.flatten(F.transform(found, parts))).drop(name, tries)
