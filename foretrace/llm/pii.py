"""Replace personal data by keyed surrogates of the same kind, gender, script and format.

DataFrame functions only. Every distinct entity gets one surrogate from a keyed hash, so mentions
of one entity agree in the whole corpus (letter case and separators of a mention do not
matter and are kept). Surrogates that two entities of a kind share, or that are real entities,
are drawn again until all are distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.store import keep

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа"
_MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин"
# Kinds in the order in which they are tried at a place. Each begins at the start of a token, and
# repetitions are bounded or possessive, so that long tokens cost no more than their length.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.\d)",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{_FEMALE}|{_MALE})\.? \p{{Lu}}\p{{Ll}}{{1,30}}(?: \p{{Lu}}\p{{Ll}}{{1,30}})?(?!\p{{L}})",
}
# Groups of the kinds are numbered when joined; the only one is the separator of cards.
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
WHOLE = ("email", "ip", "name")  # others keep each mention's separators
LATIN = ("b d f g k l m n r s t v".split(), "a e i o u".split())
CYRILLIC = ("б д ф г к л м н р с т в".split(), "а е и о у".split())
MAX_DRAWS = 50


def mentions(text: Column) -> Column:
    """All mentions in their order; none in a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def kind_of(mention: Column) -> Column:
    out = None
    for kind, pattern in KINDS.items():
        test = mention.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def _title(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^(?:{_FEMALE}|{_MALE})\.? ", 0)


def entity_of(kind: Column, mention: Column) -> Column:
    """What all mentions of an entity share: lower case, without separators or title; names
    with the gender that the title tells."""
    gender = F.when(mention.rlike(rf"^(?:{_FEMALE})\.? "), "f").otherwise("m")
    bare = F.regexp_replace(F.lower(mention), r"[^\p{L}\p{Nd}]", "")
    bare_name = F.regexp_replace(mention, rf"^(?:{_FEMALE}|{_MALE})\.? ", "")
    return F.when(kind == "name", F.concat(gender, F.lit(":"), F.lower(bare_name))).when(
        kind.isin("email", "ip"), F.lower(mention)).otherwise(bare)


def _byte(digest: Column, i) -> Column:
    """The i-th byte of a hex digest of 64 bytes, from 0."""
    place = (F.lit(i) if isinstance(i, int) else i) % 64
    return F.conv(F.substr(digest, place * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: str, n: Column) -> Column:
    return F.substr(F.lit(options), n % len(options) + 1, F.lit(1))


def _chars(text: Column, digest: Column, of) -> Column:
    """Each character c at place i (from 0) replaced by of(c, byte, i)."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: of(F.substr(text, i + 1, F.lit(1)), _byte(digest, i), i)), "")


def _like(c: Column, n: Column) -> Column:
    """A letter for a letter, a digit for a digit."""
    return F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n)).otherwise(c)


def _word(digest: Column, script: tuple[list[str], list[str]], at: int, syllables: int, end: Column | None = None) -> Column:
    consonants, vowels = ("".join(x) for x in script)
    parts = [p for k in range(syllables) for p in (_pick(consonants, _byte(digest, at + 2 * k)), _pick(vowels, _byte(digest, at + 2 * k + 1)))]
    return F.initcap(F.concat(*parts, *([end] if end is not None else [])))


def _name(entity: Column, keyed) -> Column:
    """Given name by gender and given name, family name by family name alone."""
    words = F.split(F.substring(entity, 3, 1000), " ")
    family, given = keyed(F.element_at(words, -1)), keyed(entity)

    def written(script, ends):
        end = F.when(F.substring(entity, 1, 1) == "f", ends[0]).otherwise(ends[1])
        last = _word(family, script, 0, 4)
        return F.when(F.size(words) == 1, last).otherwise(F.concat(_word(given, script, 20, 3, end), F.lit(" "), last))

    return F.when(entity.rlike(r"\p{IsCyrillic}"), written(CYRILLIC, ("на", "н"))).otherwise(written(LATIN, ("na", "n")))


def _luhn(digits: Column) -> Column:
    """The check digit for 15 digits."""
    def step(total, i):
        d = F.substr(digits, i + 1, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(14)), F.lit(0), step)
    return ((10 - total % 10) % 10).cast("string")


def surrogate(kind: Column, entity: Column, draw: Column, key: str) -> Column:
    """The surrogate of an entity at its n-th draw, in the entity's own canonical form."""
    keyed = lambda what: F.sha2(F.concat_ws(":", F.lit(key), kind, what, draw.cast("string")), 512)
    digest = keyed(entity)
    local, domain = F.split_part(entity, F.lit("@"), F.lit(1)), F.split_part(entity, F.lit("@"), F.lit(2))
    more = keyed(F.concat(F.lit("domain "), entity))
    host = _chars(F.split_part(domain, F.lit("."), F.lit(1)), more, lambda c, n, i: _like(c, n))
    email = F.concat(_chars(local, digest, lambda c, n, i: _like(c, n)), F.lit("@"), host, F.lit(".example."),
                     F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), _byte(digest, 63) % 3 + 1))
    octets = F.array_join(F.array(*[(_byte(digest, k) % 254 + 1).cast("string") for k in range(4)]), ".")
    card = _chars(F.substring(entity, 1, 15), digest, lambda c, n, i: F.when(i == 0, c).otherwise(_like(c, n)))
    hexed = _chars(entity, digest, lambda c, n, i: _pick("0123456789abcdef", n))
    phone = _chars(entity, digest, lambda c, n, i: F.when(i < F.length(entity) - 10, c).when(
        i == F.length(entity) - 10, _pick("23456789", n)).otherwise(_like(c, n)))
    iban = _chars(entity, digest, lambda c, n, i: F.when(i < 2, c).otherwise(_like(c, n)))
    return (F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "name", _name(entity, keyed))
            .when(kind == "card", F.concat(card, _luhn(card))).when(kind == "secret", hexed).when(kind == "phone", phone)
            .when(kind == "iban", iban).otherwise(_chars(entity, digest, lambda c, n, i: _like(c, n))))


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity, surrogate: no two entities of a kind share a surrogate, and none is an entity.

    entities: distinct (kind, entity). Of entities with one surrogate, the first keeps it and the
    others draw again; so does one whose surrogate is somebody's. Rounds end when nobody is left."""
    entities = keep(entities)
    done, waiting = None, entities
    for n in range(MAX_DRAWS):
        drawn = keep(waiting.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.lit(n), key)))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        free = first.join(entities.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        free = free.select("kind", "entity", "surrogate")
        done = keep(free if done is None else done.union(free))
        waiting = keep(drawn.select("kind", "entity").join(done.select("kind", "entity"), ["kind", "entity"], "left_anti"))
        if waiting.isEmpty():
            return done
    raise RuntimeError("some entities found no free surrogate")


def written(kind: Column, mention: Column, own: Column) -> Column:
    """A canonical surrogate in the format of a mention."""
    upper = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    cased = F.when(upper, F.upper(own)).otherwise(own)
    whole = F.when(kind == "name", F.concat(_title(mention), own)).otherwise(cased)
    step = lambda acc, c: F.when(c.rlike(r"[\p{L}\p{Nd}]"), F.struct(
        F.concat(acc["text"], F.substr(cased, acc["n"], F.lit(1))).alias("text"), (acc["n"] + 1).alias("n"))).otherwise(
            F.struct(F.concat(acc["text"], c).alias("text"), acc["n"].alias("n")))
    chars = F.transform(F.sequence(F.lit(1), F.length(mention)), lambda i: F.substr(mention, i, F.lit(1)))
    spelled = F.aggregate(chars, F.struct(F.lit("").alias("text"), F.lit(1).alias("n")), step)["text"]
    return F.when(kind.isin(*WHOLE), whole).otherwise(spelled)


def anonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every mention in ``text`` replaced, and __entities__, their number.

    Other columns and all rows stay; null and empty texts stay as they are; equal rows are treated
    alike. Only texts with a mention are written aside; they meet their surrogates by row number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn("__found__", mentions(text))
    plain = marked.filter(F.size("__found__") == 0).select(*docs.columns, F.lit(0).cast("long").alias("__entities__"))
    held = keep(marked.filter(F.size("__found__") > 0).withColumn("__row__", F.monotonically_increasing_id()))
    each = held.select("__row__", F.posexplode("__found__").alias("pos", "mention")).withColumn("kind", kind_of(F.col("mention"))).withColumn(
        "entity", entity_of(F.col("kind"), F.col("mention")))
    known = distinct_surrogates(each.select("kind", "entity").distinct(), key)
    new = each.join(known, ["kind", "entity"]).select("__row__", "pos", written(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new"))
    of_row = new.groupBy("__row__").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("__new__"))
    between = F.split(F.col("text"), PATTERN, -1)
    rebuilt = F.concat(F.array_join(F.transform("__new__", lambda s, i: F.concat(between[i], s)), ""), F.element_at(between, -1))
    changed = held.join(of_row, "__row__").select(
        *[rebuilt.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.size("__found__").cast("long").alias("__entities__"))
    return plain.union(changed)
