"""PII surrogates: every detected entity gets a keyed replacement of its own type, script, gender and format.

Detection and replacement are DataFrame functions on the text column, so texts are not shuffled.  An
entity's canonical form (its letters and digits in lower case) and a secret key give its surrogate, so
the same entity reads the same everywhere, however it is punctuated or cased.  The distinct entities of all
texts are checked: where two would get one surrogate, or one would get a form that occurs in the
texts, all but one move on to their next attempt, until surrogates are distinct.  Those few exceptions are
joined to the documents that need them.

A name is found behind a title; the same name, or its surname alone, is then found without one in the rest of that text.
A surname is one entity, a person (given names and surname) another: the surname of a family stays one surname, and its
members get given names that differ.  A person's gender is what the titles of all texts say of them, so a
neutral title does not change how they are called.  Initials stay initials, capitals stay capitals.
"""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, unused

KEY = "querywright"
ROUNDS = 64

_EDGE = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Titles that mark a name, by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Signor")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Signora")
NEUTRAL = ("Dr", "Prof")

#: In order: the first pattern that fits at a place wins.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "ip": r"(?<![\p{L}\p{N}.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?!\d|\.\d)",
    "number": "(?:" + "|".join([
        r"(?<![\p{L}\p{N}+])\+?\d{0,3}[ .\-]?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)",
        r"(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)",
        r"(?<![\p{L}\p{N}.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
        r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
        _EDGE + r"\d{13,19}" + _END,
        _EDGE + r"\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}" + _END,
    ]) + ")",
    "secret": "(?:" + _EDGE + r"(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{16,}+" + _END + "|" + _EDGE + r"(?:AKIA[0-9A-Z]{16}|(?:sk|ghp|gho|xoxb)[_\-][0-9A-Za-z_\-]{16,})" + ")",
    "name": _EDGE + "(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\b\.? (?:\p{Lu}(?:\.|[\p{L}'’\-]*+) )*\p{Lu}[\p{L}'’\-]+" + _END,
}
ANY = "(?:" + "|".join(PATTERNS.values()) + ")"
#: A text without this holds no name.
TITLED = "(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.? \p{Lu}"
#: A text without any of these holds no entity.
HINT = r"[0-9@]|AKIA|(?:sk|ghp|gho|xoxb)[_\-]|" + "|".join(MALE + FEMALE + NEUTRAL)

_MAIL = r"^(.*)\.([^.]+)$"
_LATIN, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
_SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бдгклмнпрствз", "аеиоу"), "greek": ("βγδκλμνπρστ", "αεηιο")}
_FEMALE_END = {"latin": "a", "cyrillic": "а", "greek": "α"}
_MALE_END = {"latin": "n", "cyrillic": "н", "greek": "ς"}


_TITLE = "^(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\b\.? "
#: A name found again without a title: no digits, and no key prefix.
_BARE = r"^(?!AKIA[0-9A-Z]{16}$)\p{Lu}[\p{L}.'’\- ]*$"
_INITIAL = r"^\p{L}\.?$"


def is_name(m: Column) -> Column:
    return m.rlike(_TITLE) | m.rlike(_BARE)


def kind_of(m: Column) -> Column:
    number = ~m.rlike(r"\p{L}")
    return (
        F.when(m.contains("@"), "email").when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip").when(number, "number").when(is_name(m), "name")
        .when(m.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"), "iban").otherwise("secret")
    )


def _untitled(m: Column) -> Column:
    return F.regexp_replace(m, _TITLE, "")


def _letters(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]", ""))


def canonical(m: Column) -> Column:
    """What makes two mentions the same entity; of a name, its last word; of an address, its top-level domain after a dot."""
    bare = _letters(F.when(kind_of(m) == "name", F.element_at(F.split(_untitled(m), " "), -1)).otherwise(m))
    mail = F.concat(_letters(F.regexp_extract(m, _MAIL, 1)), F.lit("."), F.lower(F.regexp_extract(m, _MAIL, 2)))
    return F.when(kind_of(m) == "ip", m).when(kind_of(m) == "email", mail).otherwise(bare)


def person(m: Column) -> Column:
    """Of a name with more than initials before the surname: its words in lower case; otherwise null."""
    words = F.split(_untitled(m), " ")
    given = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    told = F.exists(given, lambda w: ~w.rlike(_INITIAL))
    return F.when(is_name(m) & told, F.array_join(F.transform(words, _letters), " "))


def vote(m: Column) -> Column:
    """What a mention's title says of a person: 1 female, -1 male, 0 neither."""
    said = lambda titles: m.rlike("^(?:" + "|".join(titles) + r")\b")
    return F.when(said(FEMALE), 1).when(said(MALE), -1).otherwise(0)


def entities_of(m: Column) -> Column:
    """``(kind, canon, vote)`` of each entity in a mention: itself, and of a full name the person."""
    own = F.struct(kind_of(m).alias("kind"), canonical(m).alias("canon"), F.lit(0).alias("vote"))
    full = F.struct(F.lit("person").alias("kind"), person(m).alias("canon"), vote(m).alias("vote"))
    return F.when(person(m).isNotNull(), F.array(own, full)).otherwise(F.array(own))


def _draw(seed: Column, place: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, place), F.lit(n)).cast("int")


def _pick(alphabet: str, seed: Column, place: Column) -> Column:
    return F.substring(F.lit(alphabet), _draw(seed, place, len(alphabet)) + 1, F.lit(1))


def _seed(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 256)


def _stream(kind: Column, canon: Column, seed: Column) -> Column:
    """A letter or digit of the same kind and script for each one of ``canon``."""

    def one(c: Column, i: Column) -> Column:
        return (
            F.when((kind == "email") & (i >= F.instr(canon, ".") - 1), c)
            .when(c.rlike(r"\p{N}"), _draw(seed, i, 10).cast("string"))
            .when(kind == "secret", F.when(c.rlike("[a-f]"), _pick("abcdef", seed, i)).otherwise(_pick(_LATIN, seed, i)))
            .when((kind == "iban") & (i < 2), c)
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC, seed, i))
            .when(c.rlike(r"\p{IsGreek}"), _pick(_GREEK, seed, i))
            .otherwise(_pick(_LATIN, seed, i))
        )

    return F.array_join(F.transform(F.split(canon, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a digit string, modulo 10."""
    n = F.length(digits)

    def weigh(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when((n - i) % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d.cast("int"))

    return F.aggregate(F.transform(F.split(digits, ""), weigh), F.lit(0), lambda a, x: a + x) % 10


def _surname(canon: Column, seed: Column) -> Column:
    def made(script: str) -> Column:
        onset, vowel = _SYLLABLES[script]
        parts = [F.initcap(_pick(onset, seed, F.lit(0)))]
        for k in range(1, 10):
            parts.append(_pick(vowel if k % 2 else onset, seed, F.lit(k)))
        return F.concat(*parts)

    return _script(canon, made)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, as an array of one; keeps expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _script(word: Column, made: Callable[[str], Column]) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(word.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def _given(word: Column, nth: Column, seed: Column, gender: Column) -> Column:
    """A first name in the script of the one it stands for, with the ending of a gender (0 none, 1 female, 2 male)."""

    def made(script: str) -> Column:
        onset, vowel = _SYLLABLES[script]
        pick = lambda letters, k: _pick(letters, seed, nth * 16 + k)
        end = F.when(gender == 1, F.lit(_FEMALE_END[script])).otherwise(F.concat(pick(vowel, 7), F.when(gender == 2, F.lit(_MALE_END[script])).otherwise(F.lit(""))))
        return F.concat(pick(onset, 0), pick(vowel, 1), pick(onset, 2), pick(vowel, 3), pick(onset, 4), end)

    return _script(word, made)


def _initial(word: Column, surname: Column, key: str) -> Column:
    """Another letter of the same alphabet: all are moved on by as many places, so different initials of a family stay different."""

    def made(script: str) -> Column:
        letters = {"latin": _LATIN, "cyrillic": _CYRILLIC, "greek": _GREEK}[script]
        at = F.instr(F.lit(letters), word)
        on = F.pmod(F.xxhash64(F.lit(key), surname), F.lit(len(letters) - 1)) + 1
        return F.when(at > 0, F.substring(F.lit(letters), (F.pmod(at - 1 + on, F.lit(len(letters))) + 1).cast("int"), F.lit(1))).otherwise(word)

    return _script(word, made)


def given_names(canon: Column, attempt: Column, gender: Column, key: str) -> Column:
    """Replacements of the words before the surname of a person, in lower case."""
    words = F.split(canon, " ")

    def body(seed: Column) -> Column:
        one = lambda w, i: F.when(F.length(w) == 1, _initial(w, F.element_at(words, -1), key)).otherwise(_given(w, i, seed, gender))
        return F.transform(F.slice(words, 1, F.size(words) - 1), one)

    return _let(_seed(key, F.lit("person"), canon, attempt), body)


def surrogate_form(kind: Column, canon: Column, attempt: Column, key: str, gender: Column | None = None) -> Column:
    """The canonical form of an entity's replacement; of a person, the new given names before the old surname."""
    gender = F.lit(0) if gender is None else gender

    def number(stream: Column) -> Column:
        last = F.pmod(F.right(stream, F.lit(1)).cast("int") + _luhn(canon) - _luhn(stream), F.lit(10))
        return F.concat(F.substring(stream, F.lit(1), F.length(stream) - 1), last.cast("string"))

    def form(seed: Column) -> Column:
        ip = F.concat_ws(".", *[(_draw(seed, F.lit(k), 223 if k == 0 else 254) + 1).cast("string") for k in range(4)])
        woven = _let(_stream(kind, canon, seed), lambda stream: F.when(kind == "number", number(stream)).otherwise(stream))
        full = F.array_join(F.array_append(given_names(canon, attempt, gender, key), F.element_at(F.split(canon, " "), -1)), " ")
        return F.when(kind == "ip", ip).when(kind == "name", F.lower(_surname(canon, seed))).when(kind == "person", full).otherwise(woven)

    return _let(_seed(key, kind, canon, attempt), form)


def _woven(mention: Column, stream: Column) -> Column:
    """``mention`` with its letters and digits taken from ``stream`` in turn, in their own case."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(state: Column, c: Column) -> Column:
        taken = F.substring(stream, state["k"], F.lit(1))
        own = F.when(c.rlike(r"\p{Lu}"), F.upper(taken)).otherwise(taken)
        counts = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(state["out"], F.when(counts, own).otherwise(c)).alias("out"), (state["k"] + counts.cast("int")).alias("k"))

    return F.aggregate(F.split(mention, ""), start, step, lambda s: s["out"])


def _cased(new: Column, old: Column) -> Column:
    """``new`` with the capitals of ``old``: all of several letters, or the first."""
    return F.when(old.rlike(r"\p{L}.*\p{L}") & (old == F.upper(old)), F.upper(new)).otherwise(F.initcap(new))


def _name(m: Column, form: Column, given: Column, key: str) -> Column:
    """The title, the given names (as they are in ``given``; initials on their own) and the surname of a mention."""
    words = F.split(_untitled(m), " ")
    surname = F.element_at(words, -1)

    def one(w: Column, i: Column) -> Column:
        first = F.when(w.rlike(_INITIAL), F.concat(F.upper(_initial(_letters(w), _letters(surname), key)), F.when(w.endswith("."), ".").otherwise("")))
        return F.when(i == F.size(words) - 1, _cased(form, w)).otherwise(first.otherwise(_cased(F.get(given, i), w)))

    return F.concat(F.regexp_extract(m, _TITLE, 0), F.array_join(F.transform(words, one), " "))


def replacement(m: Column, attempt: Column, kind: Column, canon: Column, key: str, given: Column) -> Column:
    """What a mention becomes: its format, filled from its entity's surrogate."""

    def shaped(form: Column) -> Column:
        return F.when(kind == "ip", form).when(kind == "name", _name(m, form, given, key)).when(kind == "email", _email(m, form)).otherwise(_woven(m, form))

    return _let(surrogate_form(kind, canon, attempt, key), shaped)


def _email(m: Column, form: Column) -> Column:
    """The top-level domain stays."""
    return F.concat(_woven(F.regexp_extract(m, _MAIL, 1), form), F.lit("."), F.regexp_extract(m, _MAIL, 2))


def pattern_of(text: Column) -> Column:
    """``ANY``, and for a text with titled names also those names and their surnames without a title, longer ones first."""
    titled = F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)), _untitled)
    last = F.filter(F.transform(titled, lambda n: F.element_at(F.split(n, " "), -1)), lambda n: F.length(n) > 1)
    names = F.array_distinct(F.concat(titled, last, F.transform(titled, F.upper), F.transform(last, F.upper)))
    longest = F.transform(F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))), lambda x: F.replace(x["n"], F.lit("."), F.lit("[.]")))
    again = F.concat(F.lit("(?:" + ANY + "|" + _EDGE + "(?:"), F.array_join(longest, "|"), F.lit(")" + _END + ")"))
    return F.when(text.rlike(TITLED), F.when(F.size(names) > 0, again).otherwise(F.lit(ANY))).otherwise(F.lit(ANY))


def mentions(text: Column) -> Column:
    """All entity mentions of a text, in order; none for null."""
    found = F.when(text.rlike(HINT), _let(pattern_of(text), lambda p: F.regexp_extract_all(text, p, F.lit(0))))
    return F.coalesce(found, F.array().cast("array<string>"))


def exceptions(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``(kind, canon, attempt, gender)`` of the entities whose first surrogate is not theirs alone, or whose gender is known.

    ``entities`` has one row for each ``(kind, canon)``, and for persons ``gender`` (0 unknown).  After every round of moves all surrogates
    are checked anew; rounds end when all are distinct and none is the form of an entity that occurs.
    """
    form = lambda: surrogate_form(F.col("kind"), F.col("canon"), F.col("attempt"), key, F.col("gender"))
    gender = F.col("gender") if "gender" in entities.columns else F.lit(0).alias("gender")
    now = saved(entities.select("kind", "canon", gender, F.lit(0).alias("attempt")).withColumn("form", form()))
    known = now.select("kind", F.col("canon").alias("form"))
    for _ in range(ROUNDS):
        holders = now.groupBy("kind", "form").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        shared = now.join(holders, ["kind", "form"]).filter(F.struct("attempt", "canon") > F.col("first")).select("kind", "canon")
        taken = now.join(known, ["kind", "form"], "left_semi").select("kind", "canon")
        moving = saved(shared.union(taken).distinct())
        if not moving.take(1):
            break
        moved = moving.withColumn("moves", F.lit(1))
        now = now.join(moved, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("moves", F.lit(0)))
        now = saved(now.drop("moves").withColumn("form", form()))
    else:
        raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")
    return now.filter("attempt > 0 OR gender > 0").select("kind", "canon", "attempt", "gender")


def anonymize(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced, and ``n_entities`` added.

    Texts without entities, empty texts and nulls (0 entities) are unchanged; all other columns stay, whatever their names; a
    column named ``n_entities`` is replaced.
    """
    plain = docs.drop("n_entities")
    own_id, found, moves = (unused(plain, c) for c in ("own_id", "found", "moves"))
    text = F.col(f"`{text_col}`")
    each = docs.select(F.col(id_col).alias("own"), F.explode(mentions(text)).alias("m")).select("own", F.inline(entities_of(F.col("m"))))
    each = saved(each.groupBy("own", "kind", "canon").agg(F.sum("vote").alias("vote")))
    votes = each.groupBy("kind", "canon").agg(F.sum("vote").alias("vote"))
    gender = F.when(F.col("vote") > 0, 1).when(F.col("vote") < 0, 2).otherwise(0).alias("gender")
    moved = saved(exceptions(votes.select("kind", "canon", gender), key))

    # Where an entity moved or has a gender, its documents take that from a join; all others are replaced as they are read.
    entry = F.struct(F.concat_ws("\x1f", "kind", "canon").alias("e"), (F.col("attempt") * 3 + F.col("gender")).alias("a"))
    own = each.join(moved, ["kind", "canon"]).groupBy(F.col("own").alias(own_id)).agg(F.map_from_entries(F.collect_set(entry)).alias(moves))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    joined = lambda part: part.join(own, F.col(id_col).eqNullSafe(F.col(own_id)), "left").withColumn(moves, F.coalesce(moves, none)).drop(own_id)
    alone = lambda part: part.withColumn(moves, none)
    if moved.filter("kind <> 'person'").take(1):
        plain = joined(plain)
    elif moved.take(1):
        named = F.coalesce(text.rlike(TITLED), F.lit(False))
        plain = joined(plain.filter(named)).unionByName(alone(plain.filter(~named)))
    else:
        plain = alone(plain)
    plain = plain.withColumn(found, F.explode(F.array(mentions(text))))  # a generator: the patterns run once a text
    code = lambda kind, canon: F.coalesce(F.element_at(moves, F.concat_ws("\x1f", kind, canon)), F.lit(0))
    entity = lambda m: F.struct(kind_of(m).alias("kind"), canonical(m).alias("canon"), person(m).alias("person"))
    given = lambda e: _let(code(F.lit("person"), e["person"]), lambda c: given_names(e["person"], F.floor(c / 3).cast("int"), c % 3, key))
    made = lambda m, e: replacement(m, F.floor(code(e["kind"], e["canon"]) / 3).cast("int"), e["kind"], e["canon"], key, given(e))
    new = F.transform(found, lambda m: _let(entity(m), lambda e: made(m, e)))
    pieces = _let(pattern_of(text), lambda p: F.split(text, p, -1))
    whole = F.array_join(F.zip_with(pieces, F.array_append(new, F.lit("")), lambda a, b: F.concat(a, b)), "")
    out = plain.withColumn("n_entities", F.size(found).cast("long")).withColumn(text_col, F.when(F.size(found) > 0, whole).otherwise(text))
    return out.drop(found, moves)
