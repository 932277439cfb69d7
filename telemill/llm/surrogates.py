"""PII surrogates: detected entities get keyed replacements of their own type, format, script and gender.

Everything is Spark SQL functions.  Entities are found by patterns; the distinct ones make a dictionary of
(type, canonical form); a keyed digest gives each its surrogate.  Collision checks over the dictionary draw
a surrogate anew while two entities share one, or while it is itself an entity of the corpus.  So equal
entities stay equal in all documents, in whatever format they are written, and different ones different.
A name given with a title is replaced in the same document also where its words stand alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

# Fixed patterns, by type; the first that matches at a place holds.
HONORIFIC = {"m": ("Mr", "Herr", "Señor", "Monsieur", "г-н"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "г-жа")}
_TITLES = "|".join(sorted((t for ts in HONORIFIC.values() for t in ts), key=len, reverse=True))
_WORD = r"[\p{L}\p{N}]"
_NAME = rf"(?!(?:{_TITLES})\b)\p{{Lu}}(?:\.|[\p{{L}}'’-]+)"
# lower-case words inside a name
_PARTICLES = "von|van|vom|zu|zur|der|den|de|del|della|di|da|dos|du|la|le|las|los"
PATTERNS = {
    "name": rf"(?<!{_WORD})(?:{_TITLES})\.? (?:(?:{_PARTICLES}) ){{0,3}}{_NAME}(?:(?: (?:{_PARTICLES})){{0,3}} {_NAME})*+",
    # as many labels as a domain can have: an unbounded group would recurse once for each
    "email": r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?<=\bpassword=)[^\s\"']{6,}|(?<=\b(?:token|secret|api_key) = \")[^\s\"]{16,}(?=\")",
    # with a country code, or ten digits in a national format
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\w.+-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\d-])|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\.?\d)",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: An entity, or a capitalised word that may be a known name without its title.
BARE = rf"(?<!{_WORD})\p{{Lu}}(?:['’]\p{{Lu}})?\p{{L}}+(?:-\p{{Lu}}\p{{Ll}}+)*"
TOKEN = f"{ENTITY}|(?:{BARE})"

# What surrogate names are built from, by script.
SYLLABLES = {
    "latin": ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va"),
    "cyrillic": ("ба", "ве", "ди", "го", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ха"),
    "greek": ("βα", "γε", "δι", "ζο", "θυ", "κα", "λε", "μι", "νο", "πυ", "ρα", "σε", "τι", "φο", "χυ", "ψα"),
}
ENDINGS = {
    ("latin", "m"): "n", ("latin", "f"): "la", ("latin", ""): "r",
    ("cyrillic", "m"): "н", ("cyrillic", "f"): "ла", ("cyrillic", ""): "р",
    ("greek", "m"): "ς", ("greek", "f"): "λα", ("greek", ""): "ρ",
}
DIGITS = ("phone", "ssn", "card")
# The alphabets that a drawn character comes from, by the class of the original; the first that fits holds.
ALPHABETS = {
    "[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[\\p{IsCyrillic}&&\\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "\\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    "[\\p{IsGreek}&&\\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "\\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    "\\p{IsHan}": "天地人山水火木金土日月年中大小上下左右東西南北春夏秋冬", "\\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\\p{L}": "abcdefghijklmnopqrstuvwxyz", "\\p{N}": "0123456789",
}
SYMBOLS = "!#$%&*+-/:=?@^_~"
#: Draws after which symbols are drawn too, and after each so many of which a surrogate gets one more character.
SYMBOLS_FROM, WIDER_EVERY = 4, 8


def entities(text: Column) -> Column:
    """All entities of a text in order."""
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def type_of(value: Column) -> Column:
    """An entity's type: the first pattern that fits all of it, as its surroundings are gone by now."""
    bare = {
        "secret": r"^(?:AKIA[0-9A-Z]{16})$",
        **{k: rf"^(?:{p})$" for k, p in PATTERNS.items() if k != "secret"},
    }
    order = ("name", "email", "secret", "phone", "ssn", "ip", "iban", "card")
    return reduce(lambda c, k: c.when(value.rlike(bare[k]), k), order, F.when(F.lit(False), "")).otherwise("secret")


def parts(value: Column, kind: Column) -> Column:
    """An entity's parts as (type, canonical form): a name's words apart, so that a surname alone agrees.

    A phone number is its last ten digits, so that it agrees with and without a country code.
    """
    digits, plain = F.regexp_replace(value, r"\D", ""), F.regexp_replace(value, " ", "")
    one = lambda k, c: F.array(F.struct(F.lit(0).alias("at"), k.alias("type"), c.alias("canon")))
    words = F.filter(F.split(F.regexp_replace(value, rf"^(?:{_TITLES})\.? ", ""), " "), lambda w: w != "")
    male = value.rlike("^(?:" + "|".join(HONORIFIC["m"]) + r")\.? ")
    named = F.transform(
        words,
        lambda w, i: F.struct(
            i.alias("at"), F.when(w.rlike(rf"^(?:{_PARTICLES})$"), "particle").when(i == F.size(words) - 1, "family").when(male, "given_m").otherwise("given_f").alias("type"), F.lower(w).alias("canon")
        ),
    )
    return (
        F.when(kind == "name", named).when(kind == "phone", one(kind, F.right(digits, F.lit(10)))).when(kind.isin(*DIGITS), one(kind, digits)).when(kind == "email", one(kind, F.lower(value)))
        .when(kind == "iban", one(kind, plain)).otherwise(one(kind, value))
    )


def _draw(key: str, attempt: int) -> Column:
    """A keyed stream of 256 hexadecimal digits for an entity's (type, canon)."""
    seed = lambda k: F.concat_ws("\x1f", F.lit(key), F.lit(str(k)), F.col("type"), F.col("canon"), F.lit(str(attempt)))
    # twice digested with the key outside and inside, so that knowing one surrogate tells nothing of others
    return F.concat(*[F.sha2(F.concat(F.lit(key), F.sha2(seed(k).cast("binary"), 512)).cast("binary"), 512) for k in (0, 1)])


def _number(stream: Column, at: Column | int, below: int) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return F.pmod(F.conv(F.substr(stream, F.pmod(at, F.lit(124)) * 2 + 1, F.lit(6)), 16, 10).cast("long"), F.lit(below)).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n + 1, F.lit(1))


def _same_classes(value: Column, stream: Column, attempt: int, skip: int = 0) -> Column:
    """Each letter and digit after the first `skip` drawn anew from its own class; the rest stays.

    A value without letters and digits (a masked password) has its symbols drawn; after some draws symbols
    are drawn in all, and then the value grows, so that a free surrogate is found for however many.
    """
    hexadecimal = value.rlike("^(?=.*[a-f])[0-9a-f]{16,}$")
    symbols = F.lit(attempt >= SYMBOLS_FROM) | ~value.rlike("[\\p{L}\\p{N}]")

    def draw(c: Column, i: Column) -> Column:
        out = F.when(i < skip, c).when(hexadecimal, _pick("0123456789abcdef", _number(stream, i, 16)))
        out = reduce(lambda o, k: o.when(c.rlike(k), _pick(ALPHABETS[k], _number(stream, i, len(ALPHABETS[k])))), ALPHABETS, out)
        return out.when(symbols, _pick(SYMBOLS, _number(stream, i, len(SYMBOLS)))).otherwise(c)

    more = [_pick("0123456789", _number(stream, 120 - i, 10)) for i in range(attempt // WIDER_EVERY)]
    return F.concat(F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), draw), ""), *more)


def _checksum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, with a doubled last digit: what a check digit has to complete."""
    n = F.length(digits)
    value = lambda i: F.substr(digits, n - i, F.lit(1)).try_cast("int")
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 0, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i)))
    return F.aggregate(at, F.lit(0), lambda a, x: a + x)


def _card(canon: Column, stream: Column, attempt: int) -> Column:
    """The same first digit; a right check digit where the original has one."""
    drawn, body = _same_classes(canon, stream, attempt, 1), F.substr(canon, F.lit(1), F.length(canon) - 1)
    right = F.pmod(-_checksum(body), F.lit(10)) == F.substr(canon, F.length(canon), F.lit(1)).try_cast("int")
    new_body = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    return F.when(right, F.concat(new_body, F.pmod(-_checksum(new_body), F.lit(10)).cast("string"))).otherwise(drawn)


def _name(stream: Column, attempt: int) -> Column:
    script = F.when(F.col("canon").rlike(r"\p{IsCyrillic}"), "cyrillic").when(F.col("canon").rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.when(F.col("type") == "given_m", "m").when(F.col("type") == "given_f", "f").otherwise("")
    length = F.lit(3 + attempt // 4)  # more syllables when the shorter names run out
    syllable = lambda of: F.array_join(F.transform(F.sequence(F.lit(1), length), lambda i: F.element_at(F.array(*map(F.lit, of)), _number(stream, i, 16) + 1)), "")
    ending = reduce(lambda c, k: c.when((script == k[0]) & (gender == k[1]), ENDINGS[k]), ENDINGS, F.when(F.lit(False), ""))
    return F.concat(reduce(lambda c, k: c.when(script == k, syllable(SYLLABLES[k])), SYLLABLES, F.when(F.lit(False), "")), ending)


def surrogate(attempt: int) -> Column:
    """The canonical surrogate of (type, canon) at an attempt, from its stream."""
    stream, canon, kind = F.col("stream"), F.col("canon"), F.col("type")
    lower = ALPHABETS["[a-z]"]
    same = lambda value, skip=0: _same_classes(value, stream, attempt, skip)
    domain = F.concat(*[_pick(lower, _number(stream, 100 + i, 26)) for i in range(6)], F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), _number(stream, 110, 3) + 1))
    octets = F.array_join(F.array(*[(_number(stream, 3 * i, 254) + 1).cast("string") for i in range(4 + attempt // WIDER_EVERY)]), ".")
    return (
        F.when(kind == "email", F.concat(same(F.substring_index(canon, "@", 1)), F.lit("@"), domain)).when(kind == "ip", octets).when(kind == "card", _card(canon, stream, attempt))
        .when(kind == "phone", same(canon, 1)).when(kind == "iban", same(canon, 2)).when(kind.isin("family", "given_m", "given_f"), _name(stream, attempt))
        .when(canon.startswith("AKIA"), same(canon, 4)).otherwise(same(canon))
    )


def dictionary(found: DataFrame, key: str) -> DataFrame:
    """type, canon, surrogate for the distinct entities of found (type, canon): one to one within a type.

    Each round draws for the entities that have no surrogate yet.  A draw is lost where another entity owns
    the surrogate (the least of a round keeps it) or where it is an entity of the corpus.  The entities stay
    distributed; a draw is lost by chance only, and where a format has few values later draws are longer.
    """
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by number: the rows are small and the digests are the work
    real = staged(found.select("type", "canon").distinct().repartition(parts, "type", "canon"))
    done, pending = None, real
    for attempt in count():
        made = staged(pending.repartition(parts, "type", "canon").withColumn("stream", _draw(key, attempt)).withColumn("surrogate", surrogate(attempt)).drop("stream"))
        used = real.select("type", F.col("canon").alias("surrogate"))
        used = used if done is None else used.unionByName(done.select("type", "surrogate"))
        won = staged(made.groupBy("type", "surrogate").agg(F.min("canon").alias("canon")).join(used, ["type", "surrogate"], "left_anti").select("type", "canon", "surrogate"))
        done = won if done is None else done.unionByName(won)
        pending = staged(made.join(won, ["type", "canon"], "left_anti").select("type", "canon"))
        if pending.isEmpty():
            return done


def _rendered(value: Column, kind: Column, new: Column) -> Column:
    """The surrogate in the original's format: its separators, its title, its capitals."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    put = lambda own: F.aggregate(
        chars, start,
        lambda a, c: F.when(c.rlike(own), F.struct(F.concat(a["out"], F.substr(new[0], a["k"] + 1, F.lit(1))).alias("out"), (a["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
        lambda a: a["out"],
    )
    chars_out = lambda own: F.concat(put(own), F.substr(new[0], F.length(F.regexp_replace(value, rf"(?!{own}).", "")) + 1))
    title = F.regexp_extract(value, rf"^((?:{_TITLES})\.? )", 1)
    named = F.concat(title, F.array_join(F.transform(new, lambda w: F.when(w.rlike(rf"^(?:{_PARTICLES})$"), w).otherwise(F.initcap(w))), " "))
    return F.when(kind == "name", named).when(kind.isin(*DIGITS), chars_out(r"\d")).when(kind == "iban", chars_out("[A-Z0-9]")).otherwise(new[0])


def _row_key() -> list[Column]:
    """What tells a row: hashes of its id and text together, so that rows without an id are told apart."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text")).alias("k2")]


def found_in(docs: DataFrame) -> DataFrame:
    """k1, k2 (the row's key), value, kind, and at, type, canon of its parts: a row for each part of each distinct entity of a row."""
    per_doc = docs.select(*_row_key(), F.explode(F.array_distinct(entities(F.col("text")))).alias("value"))
    typed = per_doc.withColumn("kind", type_of(F.col("value")))
    return typed.select("k1", "k2", "value", "kind", F.explode(parts(F.col("value"), F.col("kind"))).alias("part")).select("k1", "k2", "value", "kind", "part.*")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """All columns, with text rewritten, and n_entities (the places that were replaced).

    Equal entities get equal surrogates in all documents; a phone or card number in another format is the
    same entity, a phone number also with and without its country code; a surname alone is that of the full
    name.  A name's words are replaced in its document also where they stand without a title, capitalised.
    Text without entities, empty and null text stay as they are (0 entities).  Rows that repeat a doc_id, or
    have none, are each rewritten by their own text.  A very long text is one value, as in any SQL function;
    no pattern recurses with its length.  An empty table gives no rows; clashing column names do not matter
    except text and n_entities, which are replaced.
    """
    found = staged(found_in(docs))
    # a particle names nobody and stays
    same = found.filter("type = 'particle'").select("type", "canon", F.col("canon").alias("surrogate")).distinct()
    drawn = staged(dictionary(found.filter("type <> 'particle'"), key))
    names = drawn.unionByName(same)
    # by distinct entity first: a hot entity is rendered once, and joined back as one row
    values = found.select("value", "kind", "at", "type", "canon").distinct().join(names, ["type", "canon"])
    new = values.groupBy("value", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("new"))
    # a country code, all before a phone's last ten digits, stays
    digits = F.regexp_replace("value", r"\D", "")
    coded = F.when(F.col("kind") == "phone", F.array(F.concat(F.substr(digits, F.lit(1), F.greatest(F.length(digits) - 10, F.lit(0))), F.col("new")[0]))).otherwise(F.col("new"))
    written = staged(new.select("value", _rendered(F.col("value"), F.col("kind"), coded).alias("new")))
    whole = found.select("k1", "k2", "value").distinct().join(written, "value")
    # words of a name that stand alone: by their lower case, behind a mark that no text's entity begins with
    bare = found.filter("type in ('family', 'given_m', 'given_f') and canon rlike '^[^.]{2,}$'").select("k1", "k2", "type", "canon").distinct().join(drawn, ["type", "canon"])
    bare = bare.groupBy("k1", "k2", "canon").agg(F.min("surrogate").alias("new")).select("k1", "k2", F.concat(F.lit("\x01"), F.col("canon")).alias("value"), F.initcap("new").alias("new"))
    maps = whole.unionByName(bare).groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("value", "new"))).alias("map"), (F.count_if(F.col("value").startswith("\x01")) > 0).alias("named"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_row_key())
    joined = rows.join(maps.hint("shuffle_hash"), ["k1", "k2"], "left")
    text, has, table = F.col("row")["text"], F.col("map").isNotNull(), F.col("map")
    tail = lambda w: F.regexp_extract(w, "(['’]s)$", 1)
    alone = lambda w: F.concat(table[F.concat(F.lit("\x01"), F.lower(F.regexp_replace(w, "['’]s$", "")))], tail(w))
    found_here = F.when(F.col("named"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(entities(text))
    gaps = F.when(F.col("named"), F.split(text, TOKEN, -1)).otherwise(F.split(text, ENTITY, -1))
    replaced = F.transform(found_here, lambda w: F.struct(w.alias("old"), F.coalesce(table[w], alone(w)).alias("new")))
    pieces = F.when(has, F.struct(gaps.alias("gaps"), replaced.alias("words")))
    out = joined.select("row", pieces.alias("p"))
    after = F.concat(F.transform("p.words", lambda w: F.coalesce(w["new"], w["old"])), F.array(F.lit("")))
    rewritten = F.array_join(F.flatten(F.zip_with("p.gaps", after, lambda g, w: F.array(g, w))), "")
    n = F.coalesce(F.size(F.filter("p.words", lambda w: w["new"].isNotNull())), F.lit(0))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "n_entities")]
    done = out.select(*kept, F.when(F.col("p").isNotNull(), rewritten).otherwise(F.col("row")["text"]).alias("text"), F.when(F.col("p").isNotNull(), n).otherwise(0).cast("long").alias("n_entities"))
    return done.select(*[f"`{c}`" for c in docs.columns], *["n_entities"] * ("n_entities" not in docs.columns))
