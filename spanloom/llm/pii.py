"""Surrogates for personal data and secrets, with DataFrame functions alone.

One regular expression finds the entities of a text; each gets a replacement derived from a keyed hash of its type and
canonical form, so the same entity has the same surrogate everywhere (coreference) without a join. A surrogate keeps
type, format, letter case and script, and for names after a title the gender. Names are replaced word by word, so a
surname is the same with and without a given name. A table of the distinct entities and words of names, far smaller
than the texts, is checked for collisions: two of them with one surrogate, or a surrogate that is itself one of them.
The later, in canonical order, moves on to its next surrogate until none collides; from the fifth try on surrogates
grow, so that rounds end however many entities share a short format. Only texts that hold such an entity take part in
a join.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import free_name, materialize

# What counts as an entity, in order of precedence. A domain has 127 labels at most, as in DNS: the JVM
# matches repeated groups by recursion, which a text must not be able to make deep.
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "M", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа")
NEUTRAL = ("Dr", "Prof")
TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
#: Keywords of secrets, in any case; a word after "password is" counts if it holds a digit.
PASSWORD, SECRET = "(?i:password|passwd|passphrase|pwd)", "(?i:token|secret|api_?key)"
PASSWORD_IS = rf"{PASSWORD} (?i:is|was):? (?=[^\s\d]*+\d)"
#: Beginnings of keys that are told by these; what follows must hold a digit.
KEY_BEGINS = r"(?:(?i:bearer) |gh[opsur]_|github_pat_|glpat-|xox[abprs]-|sk-|AIza|eyJ)(?=[A-Za-z_/+.=~-]*+\d)"
#: Words before a name that has no title, and words after these that begin no name.
CUES = r"(?:Contact|contact|Signed,?|Regards,|Sincerely,|Dear|[Nn]ame is|Name:|Author:|I am|I'm)"
NO_NAME = "Us|Our|Your|The|All|Any|This|Customer|Support|Sales|Service|Services|Team|Sir|Madam|Human|Press|Office|Information"
#: A word of a name, with hyphens and apostrophes (O'Neil, Müller-Schmidt), or initials; not the beginning of a key or an address.
PART = r"(?:(?:\p{Lu}\.)++|\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]*+)*+)(?![\p{L}\p{N}_@]|[._%+-][\p{L}\p{N}._%+-]*+@)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,24}",
    "secret": rf"{PASSWORD} ?[=:] ?\"?[^\s\",;]{{4,}}+|{PASSWORD_IS}[^\s\",;]{{6,}}+|{SECRET} ?[=:] ?\"?[A-Za-z0-9_/+.:=~-]{{16,}}+",
    "key": rf"{KEY_BEGINS}[A-Za-z0-9_/+.=~-]{{16,}}+",
    "access_key": r"\bA[KS]IA[0-9A-Z]{16}\b",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}_])",
    "ipv6": r"(?<![:.])(?=[A-Fa-f:]*+\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}_:])",
    "phone": r"\+\d{1,3}(?:[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|(?:[ .-]?\d{2,4}){2,4})(?!\d)|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d.,:/-])(?:0\d(?:[ .]\d\d){4}|0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,5})(?![ .-]?\d)",
    "card": r"(?<![\d.-])(?:(?:\d{4}[ -]){3}\d{4}(?![\d-])|\d{13,19}(?!\d))",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "name": rf"\b(?:{TITLES})\.? {PART}(?: {PART})*+|{CUES} (?!(?:{TITLES}|{NO_NAME})\b){PART}(?: {PART}){{1,3}}+",
}
#: All of them begin where no letter or digit stands before; secrets also within names, as in DB_PASSWORD or dbPassword.
ANY = r"(?:(?<![\p{L}\p{N}_])(?:" + "|".join(PATTERNS.values()) + r")|(?:(?<=_)|(?<=\p{Ll})(?=\p{Lu}))(?:" + PATTERNS["secret"] + "))"
#: What stands before the value in a match, and stays.
LEAD = rf"^(?:(?:{PASSWORD}|{SECRET}) ?[=:] ?\"?|{PASSWORD_IS}|{KEY_BEGINS}|{CUES} (?=\p{{Lu}})|(?:{TITLES})\.? (?=\p{{Lu}}))?"
TITLED = rf"(?<!\p{{L}})(?:{TITLES})\.? \p{{Lu}}"


def hint(text: Column) -> Column:
    """False only for texts that hold no entity: cheap tests come first."""
    out = text.rlike(r"[@\d]")
    out |= text.rlike(rf"(?:{PASSWORD}|{SECRET}) ?[=:]") | text.rlike(rf"{CUES} \p{{Lu}}")
    return out | (text.rlike(r"[MHSFDPг][\p{L}-]{0,7}\.? \p{Lu}") & text.rlike(TITLED))


#: Alphabets of initials.
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
#: Tries with surrogates of the entity's own length; every so many more they grow by a character.
TRIES = 4
#: Rounds after which entities of a format that can't grow (addresses of 32 bits) are taken to be too many.
MOST_ROUNDS = 200
#: Sixteen letters and syllables, for the sixteen digits of a hash.
LETTERS = "bcdfghklmnprstvw"
SYLLABLES = {
    "latin": ["ba", "be", "da", "do", "fe", "ga", "ka", "ko", "la", "le", "ma", "no", "ra", "ri", "sa", "ve"],
    "cyrillic": ["ба", "ве", "га", "до", "жа", "зи", "ка", "ко", "ла", "ле", "ма", "но", "ра", "ри", "са", "те"],
}


def _kind(lead: Column, m: Column) -> Column:
    """The type of a match; the title before a name says whether it is a man's or a woman's."""
    title = F.regexp_replace(lead, r"\.? $", "")
    out = F.when(title.isin(*MALE), "name_m").when(title.isin(*FEMALE), "name_f").when(title.isin(*NEUTRAL) | lead.rlike(f"^{CUES} $"), "name").when(lead != "", "secret")
    out = out.when(m.contains("@"), "email").when(m.rlike("^A[KS]IA"), "access_key").when(m.rlike(r"^[A-Z]{2}\d\d"), "iban").when(m.contains(":"), "ipv6")
    out = out.when(m.rlike(r"^[+(]|^\d{3}-\d{3}-|^0\d(?:[ .]\d\d){4}$|^0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,5}$"), "phone").when(m.rlike(r"^\d{3}-\d\d-"), "ssn")
    return out.when(m.contains("."), "ip").otherwise("card")


def entities(text: Column) -> Column:
    """array of (lead, value, kind, canonical) of the entities of a text, in order; empty for a null text."""
    values = F.when(hint(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    led = F.transform(values, lambda m: F.struct(F.regexp_extract(m, LEAD, 0).alias("lead"), m.alias("m")))
    kinds = F.transform(led, lambda e: F.struct(e["lead"].alias("lead"), F.substr(e["m"], F.length(e["lead"]) + 1).alias("value"), _kind(e["lead"], e["m"]).alias("kind")))
    found = F.transform(kinds, lambda e: F.struct(e["lead"].alias("lead"), e["value"].alias("value"), e["kind"].alias("kind"), canonical(e["value"], e["kind"]).alias("canonical")))
    return F.coalesce(found, F.array().cast(found_type()))


def found_type() -> str:
    return "array<struct<lead:string,value:string,kind:string,canonical:string>>"


def canonical(value: Column, kind: Column) -> Column:
    """Spellings that are one entity have one canonical form: case of addresses, and separators of numbers."""
    return F.when(kind.isin("email", "ipv6"), F.lower(value)).when(kind == "iban", F.replace(value, F.lit(" "))).when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"\D", "")).otherwise(value)


def _pad(chars: Column, attempt: Column) -> Column:
    """What a surrogate has more than its entity, after some tries."""
    return F.substr(F.concat(F.lit(""), chars), F.lit(1), F.floor(attempt / TRIES).cast("int"))


def _digits(digest: Column) -> Column:
    return F.translate(digest, "0abcdef", "7123456")


def _letters(digest: Column, letters: str = LETTERS) -> Column:
    return F.translate(digest, "0123456789abcdef", letters)


def _spell(value: Column, digest: Column, letters: str = LETTERS, separated: bool = False) -> Column:
    """Every digit and letter replaced by one that the hash picks; other characters stay, but where there is neither.
    In numbers of a bounded length that may be `separated`, separators don't count, so that all spellings go alike."""
    digits, low = _digits(digest), _letters(digest, letters)
    none = ~value.rlike(r"[0-9\p{L}]")

    def one(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), r"[^0-9\p{L}]", "")) if separated else i
        at = F.pmod(place, F.lit(64)) + 1
        return F.when(c.rlike("[0-9]"), F.substr(digits, at, F.lit(1))).when(c.rlike(r"\p{Lu}"), F.upper(F.substr(low, at, F.lit(1)))).when(c.rlike(r"\p{L}") | none, F.substr(low, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def _luhn(digits: Column) -> Column:
    """The sum of a number's digits from the right, every second doubled, modulo ten."""
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (1 + F.pmod(i, F.lit(2)).cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10


def _card(value: Column, canon: Column, digest: Column) -> Column:
    """A valid check digit stays valid; the first digit stays."""
    spelled = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(_spell(value, digest, separated=True), F.lit(2)))
    zero = F.concat(F.substr(spelled, F.lit(1), F.length(spelled) - 1), F.lit("0"))
    check = ((10 - _luhn(F.regexp_replace(zero, r"\D", ""))) % 10).cast("string")
    return F.when(_luhn(canon) == 0, F.concat(F.substr(zero, F.lit(1), F.length(zero) - 1), check)).otherwise(spelled)


def _iban_rest(text: Column) -> Column:
    """The number that an account's characters spell, letters as 10 to 35, modulo 97."""
    chars = F.filter(F.split(F.replace(text, F.lit(" ")), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _iban(value: Column, canon: Column, digest: Column) -> Column:
    """The country stays; valid check digits are followed by valid ones."""
    country, body = F.substr(value, F.lit(1), F.lit(2)), _spell(F.substr(value, F.lit(5)), digest, separated=True)
    check = F.lpad((98 - _iban_rest(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _iban_rest(F.concat(F.substr(canon, F.lit(5)), F.substr(canon, F.lit(1), F.lit(4)))) == 1
    return F.concat(country, F.when(valid, check).otherwise(_spell(F.substr(value, F.lit(3), F.lit(2)), digest)), body)


def _byte(digest: Column, k: int) -> Column:
    return F.conv(F.substr(digest, F.lit(2 * k + 1), F.lit(2)), 16, 10).cast("int")


def _word(word: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a word of a name: syllables of the word's script, five to begin with."""
    digest = F.sha2(F.concat(F.lit(key + "\0name\0"), F.lower(word), F.lit("\0"), attempt.cast("string")), 256)

    def syllable(i: Column, script: str) -> Column:
        return F.element_at(F.array(*map(F.lit, SYLLABLES[script])), F.conv(F.substr(digest, F.pmod(i, F.lit(64)) + 1, F.lit(1)), 16, 10).cast("int") + 1)

    count = F.sequence(F.lit(0), 4 + F.floor(attempt / TRIES).cast("int"))
    spelled = lambda script: F.array_join(F.transform(count, lambda i: syllable(i, script)), "")
    return F.initcap(F.when(word.rlike(r"\p{IsCyrillic}"), spelled("cyrillic")).otherwise(spelled("latin")))


def _initials(word: Column, key: str) -> Column:
    """Every letter replaced by another of its alphabet, different ones by different ones."""
    new = []
    for alphabet in ALPHABETS:
        order = list(alphabet)
        random.Random(key + alphabet).shuffle(order)
        # one place on, so that no letter stands for itself
        new.append("".join(order[(order.index(c) + 1) % len(order)] for c in alphabet))
    return F.translate(word, "".join(ALPHABETS), "".join(new))


def _name(value: Column, kind: Column, key: str, attempt: Callable[[Column], Column]) -> Column:
    """Each word by itself, at the try that attempt(word) gives. A given name ends as the gender has it."""

    def word(w: Column, i: Column, words: Column) -> Column:
        given = (i == 0) & (F.size(words) > 1)
        latin, cyrillic = (F.when(given & (kind == "name_m"), a).when(given & (kind == "name_f"), b).otherwise("") for a, b in (("n", "lia"), ("н", "ия")))
        whole = F.array_join(F.transform(F.split(w, "-"), lambda x: _word(x, attempt(x), key)), "-")
        return F.when(w.endswith("."), _initials(w, key)).otherwise(F.concat(whole, F.when(w.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin)))

    # bound once: a name can have any number of words
    bound = F.transform(F.array(F.split(value, " ")), lambda words: F.array_join(F.transform(words, lambda w, i: word(w, i, words)), " "))
    return F.element_at(bound, 1)


def surrogate(value: Column, kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity that is no name at its attempt-th try."""
    digest = F.sha2(F.concat(F.lit(key + "\0"), kind, F.lit("\0"), canon, F.lit("\0"), attempt.cast("string")), 256)
    hexed = value.rlike("^[0-9a-f]+$")
    bound = F.transform(F.array(digest), lambda d: (
        F.when(kind == "email", F.concat(_pad(_letters(d), attempt), _spell(F.regexp_replace(value, r"\.[^.]*$", ""), d), F.lit("."), F.substring_index(value, ".", -1)))
        .when(kind == "access_key", F.concat(F.substr(value, F.lit(1), F.lit(4)), _spell(F.substr(value, F.lit(5)), d)))
        .when(kind == "secret", F.when(hexed, F.concat(_spell(value, d, "abcdefabcdefabcd"), _pad(d, attempt))).otherwise(F.concat(_spell(value, d), _pad(_letters(d), attempt))))
        .when(kind == "phone", F.concat(F.regexp_extract(value, r"^(\+\d{1,3}|0)?", 0), _spell(F.regexp_replace(value, r"^(\+\d{1,3}|0)", ""), d, separated=True), _pad(_digits(d), attempt)))
        .when(kind == "iban", _iban(F.concat(value, _pad(_digits(d), attempt)), canon, d))
        .when(kind == "ipv6", F.when(attempt < TRIES, _spell(value, d, "abcdefabcdefabcd")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substr(d, i * 4 + 1, F.lit(4))), ":")))
        .when(kind == "ssn", F.concat(_spell(value, d), _pad(_digits(d), attempt)))
        .when(kind == "card", _card(F.concat(value, _pad(_digits(d), attempt)), canon, d))
        .otherwise(F.concat_ws(".", 1 + _byte(d, 0) % 223, _byte(d, 1), _byte(d, 2), 1 + _byte(d, 3) % 254))
    ))
    return F.element_at(bound, 1)


def tried(e: Column) -> Column:
    """array of (kind, canonical, value) of what an entity's surrogate is made from: the words of a name that aren't
    initials, or the entity."""
    words = F.flatten(F.transform(F.filter(F.split(e["value"], " "), lambda w: ~w.endswith(".")), lambda w: F.split(w, "-")))
    of_name = F.transform(words, lambda w: F.struct(F.lit("word").alias("kind"), F.lower(w).alias("canonical"), w.alias("value")))
    return F.when(e["kind"].startswith("name"), of_name).otherwise(F.array(F.struct(e["kind"].alias("kind"), e["canonical"].alias("canonical"), e["value"].alias("value"))))


def retries(found: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, attempt) of the entities and words whose first surrogate collides, from
    found(kind, canonical, value).

    Rounds go on until no surrogate is shared, nor itself in the table; each round is written to the shared folder."""
    table = materialize(found.groupBy("kind", "canonical").agg(F.min("value").alias("value")).withColumn("attempt", F.lit(0)), "entities")
    real = table.select("kind", F.col("canonical").alias("new"))
    for _ in range(MOST_ROUNDS):
        new = F.when(F.col("kind") == "word", F.lower(_word(F.col("value"), F.col("attempt"), key))).otherwise(canonical(surrogate(F.col("value"), F.col("kind"), F.col("canonical"), F.col("attempt"), key), F.col("kind")))
        tries = materialize(table.withColumn("new", new), "tries")
        # of those that share a surrogate the least canonical form keeps it
        taken = tries.groupBy("kind", "new").agg(F.min("canonical").alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "new", "first")
        bad = tries.join(taken, ["kind", "new"]).where("canonical <> first").select("kind", "canonical")
        bad = materialize(bad.union(tries.join(real, ["kind", "new"], "left_semi").select("kind", "canonical")).distinct(), "collisions")
        if bad.isEmpty():
            return table.where("attempt > 0").select("kind", "canonical", "attempt")
        table = materialize(table.join(bad.withColumn("again", F.lit(1)), ["kind", "canonical"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again"), "entities")
    raise RuntimeError("there are too many entities of one format for distinct surrogates")


def pseudonymise(docs: DataFrame, key: str = "spanloom", report: bool = False) -> DataFrame:
    """docs(text, ...) with every entity of every whole text replaced by its surrogate; with `report`, also entities:
    array of (kind, lead, surrogate).

    A null text stays null and an empty one empty; texts without an entity stay as they are, byte for byte. Repeated
    rows and other columns stay, whatever their names, but for `entities` with `report`, which is an error. An empty
    table gives an empty one. The same key gives the same surrogates in every run over the same corpus."""
    if report and "entities" in (c.lower() for c in docs.columns):
        raise ValueError("docs has a column named entities")
    found_name, tries_name, h1, h2, new_name = (free_name(x, docs) for x in ("_entities", "_tries", "_h1", "_h2", "_new"))
    parts = F.explode(F.flatten(F.transform(entities(F.col("text")), tried))).alias("e")
    found = materialize(docs.where(hint(F.col("text"))).select(parts).select("e.kind", "e.canonical", "e.value").groupBy("kind", "canonical").agg(F.min("value").alias("value")), "found")
    again = materialize(retries(found, key), "retries")
    marked = docs.withColumn(found_name, entities(F.col("text")))
    if again.isEmpty():
        marked = marked.withColumn(tries_name, F.lit(None).cast("map<string,int>"))
    else:
        keys = [F.xxhash64("text").alias(h1), F.xxhash64(F.lit(1), "text").alias(h2)]
        hit = docs.where(hint(F.col("text"))).select(*keys, parts).select(h1, h2, "e.kind", "e.canonical").distinct()
        hit = hit.join(again, ["kind", "canonical"]).groupBy(h1, h2).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("\0"), "canonical"), "attempt"))).alias(tries_name))
        marked = marked.withColumns({h1: F.xxhash64("text"), h2: F.xxhash64(F.lit(1), "text")}).join(hit, [h1, h2], "left").drop(h1, h2)
    tries = F.coalesce(F.col(tries_name), F.create_map().cast("map<string,int>"))

    def attempt(kind: Column, canon: Column) -> Column:
        return F.coalesce(F.element_at(tries, F.concat(kind, F.lit("\0"), canon)), F.lit(0))

    def new(e: Column) -> Column:
        of_name = _name(e["value"], e["kind"], key, lambda w: attempt(F.lit("word"), F.lower(w)))
        return F.when(e["kind"].startswith("name"), of_name).otherwise(surrogate(e["value"], e["kind"], e["canonical"], attempt(e["kind"], e["canonical"]), key))

    replaced = F.transform(found_name, lambda e: F.struct(e["kind"].alias("kind"), e["lead"].alias("lead"), new(e).alias("surrogate")))
    marked = marked.withColumn(new_name, F.when(F.size(found_name) > 0, replaced))
    at = lambda i: F.get(F.col(new_name), i)
    pieces = F.when(F.col(new_name).isNotNull(), F.split("text", ANY, -1))
    text = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.concat(at(i)["lead"], at(i)["surrogate"]), F.lit("")))), "")
    out = marked.withColumn("text", F.when(F.col(new_name).isNotNull(), text).otherwise(F.col("text")))
    if report:
        return out.select(*docs.columns, F.coalesce(new_name, F.array().cast("array<struct<kind:string,lead:string,surrogate:string>>")).alias("entities"))
    return out.select(docs.columns)
