"""PII surrogates: detected entities get keyed replacements of their own type, script and format, and for names gender.

Entities are found by one pattern, and reduced to a canonical form, so that writings of one number share a surrogate.
Names are taken apart: a family name, with the gender of its bearer, and a given name have surrogates of their own, so
that a person has one family name with or without a given one, and bearers of different gender differ. A family name
that stands alone in a document follows its first full mention there. Distinct entities are a table. A surrogate is drawn
from a keyed hash of the entity and a try; where two entities draw the same, or one draws what the corpus really has, all
but one draw again, until all are distinct. After some tries surrogates get longer with each, so that there are enough
for any number of entities. The pattern goes over each text once; texts that have entities are joined with their
surrogates and put together again, the others are not shuffled. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.work import written

#: Forms of address before a name, and given names, by gender.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Госпожа", "Κυρία"],
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"],
    "n": ["Mx", "Dr", "Prof"],
}
GIVEN = {
    "f": ["Alice", "Anna", "Carla", "Claire", "Elena", "Emma", "Greta", "Helen", "Ines", "Julia", "Laura", "Lucia", "Maria", "Marie", "Nora", "Paula", "Rosa", "Sarah", "Sofia", "Vera"],
    "m": ["Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Hugo", "Ivan", "Jacob", "Jean", "John", "Karl", "Louis", "Marco", "Oscar", "Paul", "Peter", "Robert", "Simon", "Thomas"],
    "n": ["Alex", "Andrea", "Chris", "Dominique", "Jules", "Kim", "Robin", "Sam", "Sascha", "Toni"],
}
CYRILLIC_GIVEN = {"f": ["Анна", "Вера", "Елена", "Мария", "Нина", "Ольга"], "m": ["Антон", "Борис", "Иван", "Олег", "Павел", "Пётр"], "n": ["Женя", "Саша"]}
SYLLABLES = ["ba", "der", "fal", "gan", "hol", "ka", "lin", "mar", "nes", "por", "ral", "sen", "tor", "ul", "ver", "wen"]
CYRILLIC_SYLLABLES = ["ба", "вер", "гон", "дар", "зел", "ка", "лин", "мар", "нес", "пор", "рал", "сен", "тор", "ул", "фед", "чен"]

GREEK_GIVEN = {"f": ["Άννα", "Ελένη", "Ιωάννα", "Μαρία", "Σοφία"], "m": ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"], "n": ["Σασα", "Φώτις"]}
GREEK_SYLLABLES = ["βα", "δερ", "γαλ", "θο", "κα", "λιν", "μαρ", "νες", "πορ", "ραλ", "σεν", "τορ", "φαν", "χαλ", "ζε", "ρος"]
#: Words after which a name follows, whatever its words are.
CUES = ["my name is", "My name is", "Name:", "name:", "signed by", "Signed by", "Contact:", "Author:", "Mein Name ist", "mein Name ist", "Me llamo", "me llamo", "Je m'appelle", "je m'appelle", "Меня зовут", "меня зовут"]
NAMES = (GIVEN, CYRILLIC_GIVEN, GREEK_GIVEN)
LISTED = "|".join(x for own in NAMES for y in own.values() for x in y)
TITLED = "|".join(x for own in TITLES.values() for x in own)

#: A capitalised word, without the 's of a possessive.
WORD = r"\p{Lu}(?:[\p{L}-]|['’](?!s\b))*\p{Ll}"
#: Patterns by type, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"\b(?:AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_-]{16,}|[0-9a-f]{32,128}|[0-9A-F]{32,128})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    # Only capital letters are looked at closer.
    "name": rf"(?=\p{{Lu}})(?:\b(?:(?:{TITLED})\.?\s+{WORD}(?:\s{WORD})?|(?:{LISTED})\s{WORD})|(?<=(?:{'|'.join(CUES)})\s){WORD}(?:\s{WORD}){{0,2}})(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these, nor a cue, has no entity: what every match of a pattern, in their order, holds. A phone number that does not start with + holds three digits in a row.
HINT = r"(?=[@A-Zspgx\d+a-f])(?:@|AKIA|(?:sk|pk|ghp|gho|xox[bp])[-_]|[0-9a-fA-F]{32}|[A-Z]{2}\d{2}|\d\.\d|\d{3}|\+\d|\d(?:[ -]?\d){12})|(?=\p{Lu})(?:" + f"{TITLED}|{LISTED})\\.?\\s"


def may_hold(text: Column) -> Column:
    """Whether a text may have an entity."""
    out = text.rlike(HINT)
    for cue in CUES:
        out = out | F.contains(text, F.lit(cue))
    return out


#: Draws in an entity's own format; each later one is a syllable, letter or digit longer than the one before.
TRIES = 4
ALPHABETS = {"[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя", r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", r"\p{Lu}": "ÀÂÄÇÈÉÊËÎÏÔÖÙÛÜÑÍÓÚÁ", r"\p{L}": "àâäçèéêëîïôöùûüñíóúá"}


def kind(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        # What is of no other type was found after a cue.
        out = F.lit(name) if name == "name" else F.when(F.regexp_extract(entity, f"^(?:{pattern})$", 0) == entity, F.lit(name)).otherwise(out)
    return out


def canonical(entity: Column, type_: Column) -> Column:
    """One form for all writings of an entity: digits of numbers, small letters of addresses, a name less its form of address."""
    return (
        F.when(type_ == "phone", F.concat(F.regexp_extract(entity, r"^\+?", 0), F.regexp_replace(entity, r"\D", "")))
        .when(type_.isin("card", "ssn"), F.regexp_replace(entity, r"\D", ""))
        .when(type_ == "email", F.lower(entity))
        .when(type_ == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(type_ == "name", F.regexp_replace(F.regexp_replace(entity, rf"^(?:{TITLED})\.?\s+", ""), r"\s+", " "))
        .otherwise(entity)
    )


def gender(entity: Column) -> Column:
    """By form of address, else by given name, else neutral."""
    out = F.lit("n")
    for lists in (*NAMES, TITLES):
        for g in ("f", "m"):
            out = F.when(entity.rlike(rf"(?<!\p{{L}})(?:{'|'.join(lists[g])})(?!\p{{L}})"), F.lit(g)).otherwise(out)
    return out


def _number(stream: Column, i: Column | int) -> Column:
    """The i-th of a stream's 60 numbers under 65536 or so; hex digits overlap, as only a spread is needed."""
    return F.conv(F.substring(stream, F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")


def _of(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))) + 1)


def _scrambled(text: Column, stream: Column) -> Column:
    """A letter for each letter, of its script and case, a digit for each digit; the rest as it is."""

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i * 7)
        out = c
        for pattern, letters in reversed(ALPHABETS.items()):
            out = F.when(c.rlike(pattern), F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
        return F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string")).otherwise(out)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _more(values: list[str], stream: Column, attempt: Column) -> Column:
    """What a try's surrogate is longer by: one of the values for each try after the first ones, each from a stream of its own."""
    one = lambda i: _of(values, _number(F.sha2(F.concat_ws("\n", stream, i.cast("string")), 256), 0))
    return F.when(attempt >= TRIES, F.array_join(F.transform(F.sequence(F.lit(1), attempt - TRIES + 1), one), "")).otherwise("")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    added = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2 - 1, F.lit(9)) + F.when(c == "0", 0).otherwise(1) - F.when(c == "0", 8).otherwise(0)))
    return F.pmod(F.aggregate(added, F.lit(0), lambda a, x: a + x), F.lit(10))


def surrogate(type_: Column, own: Column, sex: Column, key: str, attempt: Column) -> Column:
    """Replacement of a canonical entity."""
    stream = F.sha2(F.concat_ws("\n", F.lit(key), type_, own, sex, attempt.cast("string")), 256)
    body = F.regexp_extract(own, r"^(.*@.*)(\.[^.]*)$", 1)
    top = F.regexp_extract(own, r"^(.*@.*)(\.[^.]*)$", 2)
    letters, figures = _more(list(ALPHABETS["[a-z]"]), stream, attempt), _more(list("0123456789"), stream, attempt)
    email = F.concat(F.replace(_scrambled(body, stream), F.lit("@"), F.concat(letters, F.lit("@"))), top)
    ip = F.array_join(F.array(*[(F.pmod(_number(stream, i * 5), F.lit(222 if i == 0 else 254)) + 1).cast("string") for i in range(4)]), ".")
    ip = F.concat(ip, F.when(figures != "", F.concat(F.lit("."), figures)).otherwise(""))
    digits = _scrambled(own, stream)
    # A card's last digit keeps its check sum right, or wrong as it was.
    start = F.substring(digits, F.lit(1), F.length(digits) - 1)
    start = F.concat(F.substring(own, 1, 1), F.substring(start, F.lit(2), F.length(start)), figures)
    check = F.pmod(_luhn(own) - _luhn(F.concat(start, F.lit("0"))), F.lit(10)).cast("string")
    card = F.concat(start, check)
    # A phone number's country code, of one digit if 1 or 7 and of two at least otherwise, stays.
    code = F.regexp_extract(own, r"^(?:\+(?:[17]|\d\d))?", 0)
    phone = F.concat(code, F.substring(digits, F.length(code) + 1, F.length(digits)), figures)
    iban = F.concat(F.substring(own, 1, 2), _scrambled(F.substring(own, F.lit(3), F.length(own)), stream), figures)
    secret = F.when(own.rlike("^[0-9a-f]+$"), F.substring(F.concat(stream, F.sha2(stream, 256)), F.lit(1), F.length(own))).when(own.rlike("^[0-9A-F]+$"), F.upper(F.substring(F.concat(stream, F.sha2(stream, 256)), F.lit(1), F.length(own)))).otherwise(F.concat(F.substring(own, 1, 4), _scrambled(F.substring(own, F.lit(5), F.length(own)), stream)))
    secret = F.concat(secret, figures)

    def scripted(one) -> Column:  # noqa: ANN001
        return F.when(own.rlike(r"\p{IsCyrillic}"), one(CYRILLIC_GIVEN, CYRILLIC_SYLLABLES)).when(own.rlike(r"\p{IsGreek}"), one(GREEK_GIVEN, GREEK_SYLLABLES)).otherwise(one(GIVEN, SYLLABLES))

    def given(lists: dict[str, list[str]], _: list[str]) -> Column:
        """A name of the gender, and after the first tries more such names behind it."""
        one = lambda g: F.concat_ws("-", _of(lists[g], _number(stream, 0)), F.when(attempt >= TRIES, F.array_join(F.transform(F.sequence(F.lit(1), attempt - TRIES + 1), lambda i: _of(lists[g], _number(F.sha2(F.concat_ws("\n", stream, i.cast("string")), 256), 0))), "-")))
        return F.when(sex == "f", one("f")).when(sex == "m", one("m")).otherwise(one("n"))

    def family(_: dict[str, list[str]], syllables: list[str]) -> Column:
        return F.initcap(F.concat(*[_of(syllables, _number(stream, 6 * i + 5)) for i in range(4)], _more(syllables, stream, attempt)))

    names = F.when(type_ == "given", scripted(given)).otherwise(scripted(family))
    return F.when(type_ == "email", email).when(type_ == "ip", ip).when(type_ == "phone", phone).when(type_ == "card", card).when(type_ == "iban", iban).when(type_ == "secret", secret).when(type_.isin("given", "family"), names).otherwise(F.concat(digits, figures))


def rendered(entity: Column, type_: Column, replacement: Column) -> Column:
    """A canonical surrogate in the format of one writing of its entity; what it is longer by follows."""
    replacement = F.when(type_ == "phone", F.replace(replacement, F.lit("+"), F.lit(""))).otherwise(replacement)
    spread = F.aggregate(F.split(entity, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), lambda a, c: F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(a["out"], F.substring(replacement, a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"))), lambda a: F.concat(a["out"], F.substring(replacement, a["i"], F.length(replacement))))
    return F.when(type_.isin("phone", "card", "ssn", "iban"), spread).when(type_ == "name", F.concat(F.regexp_extract(entity, rf"^(?:(?:{TITLED})\.?\s+)?", 0), replacement)).otherwise(replacement)


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """(type, own, sex, surrogate) of distinct (type, own, sex): surrogates are distinct within a type, and none is an entity of the corpus; of given names, which many share, only none is the name itself."""
    names = ["type", "own", "sex"]
    drawn = entities.select(*names).withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("type"), F.col("own"), F.col("sex"), key, F.col("attempt")))
    drawn = written(drawn, "surrogates")
    real = entities.where("type <> 'given'").select("type", F.col("own").alias("surrogate"))
    while True:
        first = drawn.groupBy("type", "surrogate").agg(F.min(F.struct("own", "sex")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        clash = drawn.join(first, ["type", "surrogate"]).where(F.struct("own", "sex") != F.col("first")).select(*names)
        taken = drawn.join(real, ["type", "surrogate"], "left_semi").select(*names).unionByName(drawn.where("surrogate = own").select(*names))
        clash = written(clash.unionByName(taken).distinct(), "clashes")
        if clash.isEmpty():
            return drawn.select(*names, "surrogate")
        again = drawn.join(clash, names, "left_semi").withColumn("attempt", F.col("attempt") + 1)
        again = again.withColumn("surrogate", surrogate(F.col("type"), F.col("own"), F.col("sex"), key, F.col("attempt")))
        drawn = written(drawn.join(clash, names, "left_anti").unionByName(again), "surrogates")


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, text with surrogates, n_entities (matches of the pattern), types (sorted, distinct).

    Equal entities of a type, in whatever format, get one surrogate throughout, and different ones different surrogates.
    Names are equal by family name and gender, and by given name and gender; gender is that of the form of address, else
    of a listed given name, else neutral. A family name alone in a document of which a name was found gets the surrogate
    of its first mention there. Null texts stay null and have no entities; the rest of a text is unchanged. Rows with
    equal ids, null ids too, are handled each by its text. The same key gives the same surrogates for the same corpus.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # All texts are written with their entities, so that the pattern goes over the corpus once.
    found = written(rows.withColumn("entities", F.when(may_hold(F.col("text")), F.regexp_extract_all("text", F.lit(ANY), 0))), "entities")
    has = F.coalesce(F.size("entities") > 0, F.lit(False))
    some = found.where(has)
    writings = some.select(F.explode("entities").alias("entity")).distinct().withColumn("type", kind(F.col("entity")))
    writings = writings.withColumn("own", canonical(F.col("entity"), F.col("type"))).withColumn("sex", F.when(F.col("type") == "name", gender(F.col("entity"))).otherwise("n"))
    words = F.split("own", " ")
    writings = writings.withColumn("family", F.when(F.col("type") == "name", F.element_at(words, -1)))
    writings = writings.withColumn("given", F.when((F.col("type") == "name") & (F.size(words) > 1), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")))
    writings = written(writings, "writings")
    parts = [writings.where(F.col(c).isNotNull()).select(F.lit(c).alias("type"), F.col(c).alias("own"), "sex") for c in ("family", "given")]
    chosen = mapping(writings.where("type <> 'name'").select("type", "own", "sex").unionByName(parts[0]).unionByName(parts[1]).distinct(), key)
    of = lambda c: chosen.where(F.col("type") == c).select(F.col("own").alias(c), "sex", F.col("surrogate").alias(f"{c}_"))
    plain = writings.where("type <> 'name'").join(chosen, ["type", "own", "sex"]).select("entity", "type", F.col("surrogate"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("family_"))
    names = writings.where("type = 'name'").join(of("family"), ["family", "sex"]).join(of("given"), ["given", "sex"], "left").select("entity", "type", F.concat_ws(" ", "given_", "family_").alias("surrogate"), "family", "family_")
    named = plain.unionByName(names).select("entity", "type", rendered(F.col("entity"), F.col("type"), F.col("surrogate")).alias("replacement"), "family", "family_")
    place = some.select(F.xxhash64("id", "text").alias("row"), "id", "text", "entities")
    wanted = place.select("row", F.posexplode(F.array_distinct("entities")).alias("at", "entity")).distinct().join(named, "entity")
    wanted = written(wanted, "wanted")
    pairs = wanted.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("entity", "replacement"))).alias("by"), F.sort_array(F.collect_set("type")).alias("types"))
    alone = wanted.where("family is not null").groupBy("row", "family").agg(F.min_by("family_", "at").alias("family_")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("family", "family_"))).alias("families"))
    gaps = F.split("text", ANY, -1)
    tokens = lambda g: F.array_join(F.transform(F.regexp_extract_all(g, F.lit(r"[\p{L}-]+(?:['’](?!s\b)[\p{L}-]+)*|[^\p{L}-]+"), 0), lambda t: F.coalesce(F.element_at("families", t), t)), "")
    gap = lambda g: F.when(F.col("families").isNull(), g).otherwise(tokens(g))
    pieces = F.transform(gaps, lambda g, i: F.concat(gap(g), F.coalesce(F.element_at("by", F.get("entities", i)), F.get("entities", i), F.lit(""))))
    done = place.join(pairs, "row").join(alone, "row", "left").select("id", F.array_join(pieces, "").alias("text"), F.size("entities").cast("long").alias("n_entities"), "types")
    rest = found.where(~has).select("id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("types"))
    return done.unionByName(rest).withColumnRenamed("id", id_col)
