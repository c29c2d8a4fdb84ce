"""Personal data replaced by surrogates, in DataFrame functions alone.

Detection is one pattern with an alternative per kind, so mentions never overlap.  Mentions of one entity (the digits
of a phone number however it is written, an address in either case, a surname after any title) share a normal form,
and the normal form and a key give the surrogate: same kind, digits for digits, letters for letters of the same case,
syllables of the same script, given names of the gender a title tells.  A person is its given
names and surname; each of these words is an entity of its own, so two persons never share a full surrogate.  Card
numbers and IBANs keep valid check digits.  All distinct entities of the table are then checked together: where two of
them, or a surrogate and a real entity, coincide, all but one draw again, until the map is one to one.  Shapes of digits
alone get a digit more from their eighth further draw on (an IP address gets parts above 255), so none runs out.  Texts are
parsed once and written in pieces; the finished map is joined back to the pieces, and texts are rebuilt around them.

Persons are found by titles, and by what titles teach: a word that stands between a title and at least ``learn_from``
different surnames is a given name, and so it is in any text of the table where a capitalised word follows it.

Every repeat in the pattern is bounded, or possessive and so matched without recursion or backtracking, whatever the
length of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

_OPEN, _CLOSE = "\u0001", "\u0002"
#: What stands for marks (and for the escape itself) that a text has already; undone when it is rebuilt.
_ESCAPES = (("\u0003", "\u0003\u0004"), (_OPEN, "\u0003\u0005"), (_CLOSE, "\u0003\u0006"))
#: Titles by the gender that they tell.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Госпожа"), "n": ("Dr", "Prof")}
#: Surrogate given names by script and gender; no list of real persons.
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carlo", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Max", "Noel", "Oscar", "Paul"),
    ("latin", "f"): ("Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Klara", "Lena", "Maria", "Nora", "Olga", "Paula"),
    ("latin", "n"): ("Alex", "Robin", "Kim", "Sascha", "Toni", "Andrea", "Luca", "Nikita"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Олег"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава"),
}
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga go ha he ka ke ki ko la le li lo ma me mi mo na ne ra re ri ro".split(), "cyrillic": "ба бе бо бу ва ве во ву га го да де до ка ко ку ла ле ло лу ма ме мо му на не но ра ре ро са со".split()}
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"

_ALL_TITLES = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_LEAD = rf"(?:(?:{_ALL_TITLES})\.?\x20)++"
#: A name word: no title, and a possessive 's is no part of it.  Initials may stand before the surname.
_NAME = rf"(?!(?:{_ALL_TITLES})(?!\p{{L}}))\p{{Lu}}(?:\p{{L}}++|['’-](?!s(?!\p{{L}}))(?=\p{{L}}))++"
_INITIALS = r"(?:\p{Lu}\.\x20)*+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++)++",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])(?!\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)\x20?[0-9]{3}[.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "name": rf"(?<!\p{{L}}){_LEAD}{_INITIALS}{_NAME}(?:\x20{_INITIALS}{_NAME})*+",
}
#: Between a word and what surrounds it.
_EDGES = r"(?<=\p{L})(?!\p{L}|['’-](?!s(?!\p{L}))\p{L})(?=.|\s)|(?<!\p{L}|\p{L}['’-])(?=\p{L})"
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Two or more name words in a row: where a learnt given name may stand before a surname.
RUN = rf"(?<!\p{{L}})(?<!\p{{L}}['’-]){_NAME}(?:\x20{_INITIALS}{_NAME})++"
MENTION = "struct<kind:string,text:string,norm:string,script:string,gender:string,given:array<string>>"


def _luhn_sum(digits: Column, shift: int) -> Column:
    """Sum of the Luhn rule; ``shift`` 0: every second digit from the one before the last counts twice, 1: from the last."""
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when((i + shift) % 2 == 0, c.cast("int")).otherwise(twice(c.cast("int"))))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _luhn(digits: Column) -> Column:
    return _luhn_sum(digits, 0) % 10 == 0


def _with_luhn(digits: Column) -> Column:
    """The digits with their last one replaced by the check digit of the others."""
    body = F.substring(digits, F.lit(1), F.char_length(digits) - 1)
    return F.concat(body, ((F.lit(10) - _luhn_sum(body, 1) % 10) % 10).cast("string"))


def _with_mod97(iban: Column) -> Column:
    """Country and account with the two check digits that make the rearranged number 1 modulo 97."""
    moved = F.concat(F.substring(iban, 5, 60), F.substring(iban, 1, 2), F.lit("00"))
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).when(c.rlike("[A-Z]"), a * 100 + F.ascii(c) - 55).otherwise(a) % 97
    left = F.aggregate(F.split(moved, ""), F.lit(0), step)
    return F.concat(F.substring(iban, 1, 2), F.lpad((F.lit(98) - left).cast("string"), 2, "0"), F.substring(iban, 5, 60))


def _mention(text: Column) -> Column:
    """The kind, normal form, script and gender of a match."""
    kind = F.lit("name")
    for k in reversed([k for k in KINDS if k != "name"]):
        kind = F.when(text.rlike(f"^(?:{KINDS[k]})$"), F.lit(k)).otherwise(kind)
    digits = F.regexp_replace(text, r"[^0-9]", "")
    last = F.substring_index(text, " ", -1)
    title = F.regexp_extract(text, rf"^({_ALL_TITLES})", 1)
    norm = F.when(kind == "name", F.lower(last)).when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.regexp_replace(text, " ", "")).otherwise(F.lower(text))
    gender = F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise("n")
    script = F.when(last.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    # Given names: what stands between title and surname, without full stops.
    words = F.split(F.regexp_replace(F.lower(F.regexp_replace(text, rf"^{_LEAD}", "")), r"\.", ""), " ")
    given = F.when(kind == "name", F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.struct(kind.alias("kind"), text.alias("text"), norm.alias("norm"), script.alias("script"), gender.alias("gender"), given.alias("given"))


def _escaped(text: Column) -> Column:
    out = text
    for plain, code in _ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return F.when(text.rlike("[\u0001-\u0003]"), out).otherwise(text)


def _unescaped(text: Column) -> Column:
    out = text
    for plain, code in reversed(_ESCAPES):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.when(F.contains(text, F.lit("\u0003")), out).otherwise(text)


def _pieces(text_col: str) -> Column:
    """A text in turns: array<struct<mention, after>>; the first has no mention.  ``after``: plain text that follows."""
    parts = F.split(F.regexp_replace(_escaped(F.col(text_col)), F.lit(PATTERN), F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN)
    none = F.lit(None).cast(MENTION)

    def piece(part: Column, i: Column) -> Column:
        match, after = F.substring_index(part, _CLOSE, 1), F.substring_index(part, _CLOSE, -1)
        found = _mention(match)
        card = (found["kind"] != "card") | _luhn(found["norm"])
        return F.when(i == 0, F.struct(none.alias("mention"), part.alias("after"))).when(card, F.struct(found.alias("mention"), after.alias("after"))).otherwise(F.struct(none.alias("mention"), F.concat(match, after).alias("after")))

    return F.transform(parts, piece)


def _draw(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """Hex digits that key, kind, entity and attempt decide."""
    seed = F.concat_ws("\u0000", F.lit(key), kind, norm, attempt.cast("string"))
    return F.concat(F.sha2(seed.cast("binary"), 512), F.sha2(F.concat(seed, F.lit("+")).cast("binary"), 512))


def _number(draw: Column, i: Column) -> Column:
    return F.conv(F.substring(draw, (i * 3 % 253 + 1).cast("int"), F.lit(3)), 16, 10).cast("int")


def surrogate(key: str, kind: Column, norm: Column, script: Column, gender: Column, attempt: Column) -> Column:
    """The surrogate's normal form.  A given name is one of GIVEN, with two more syllables each time it draws again; a
    surname gets one more each time, and an address gets syllables from its third further draw on."""
    # Bound by a lambda, so that the digits are drawn once for an entity and not once for each of its characters.
    return F.get(F.transform(F.array(_draw(key, kind, norm, attempt)), lambda draw: _from_draw(draw, kind, norm, script, gender, attempt)), F.lit(0))


def _from_draw(draw: Column, kind: Column, norm: Column, script: Column, gender: Column, attempt: Column) -> Column:
    chars = F.transform(
        F.split(norm, ""),
        lambda c, i: F.when(c.rlike("[0-9]"), (_number(draw, i) % 10).cast("string")).when(c.rlike("[a-z]"), F.char(_number(draw, i) % 26 + 97)).when(c.rlike("[A-Z]"), F.char(_number(draw, i) % 26 + 65)).when(c.rlike(r"\p{IsCyrillic}"), F.element_at(F.split(F.lit(CYRILLIC), ""), _number(draw, i) % 32 + 1)).when(c.rlike(r"\p{L}"), F.char(_number(draw, i) % 26 + 97)).otherwise(c),
    )
    # Each further draw from the eighth on takes a digit more, or parts that no real address has.
    longer = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt - 6, F.lit(1))), lambda i: F.when(i < attempt - 6, (_number(draw, i + 61) % 10).cast("string")).otherwise("")), "")
    octets = F.transform(F.split(norm, r"\."), lambda c, i: F.when(attempt > 7, _number(draw, i) % 744 + 256).otherwise(_number(draw, i) % 254 + 1).cast("string"))
    said = F.when(script == "cyrillic", F.array(*map(F.lit, SYLLABLES["cyrillic"]))).otherwise(F.array(*map(F.lit, SYLLABLES["latin"])))
    # A surname has as many parts as the real one, with the same marks between them; its last part grows.
    parts = F.split(norm, r"['’-]")
    marks = F.split(F.regexp_replace(norm, r"[^'’-]", ""), "")
    part = lambda k: F.array_join(F.transform(F.sequence(F.lit(0), F.when(F.size(parts) == 1, F.lit(3)).otherwise(1) + F.when(k == F.size(parts) - 1, attempt).otherwise(0)), lambda i: F.element_at(said, _number(draw, i + k * 7) % 32 + 1)), "")
    surname = F.array_join(F.transform(parts, lambda _, k: F.concat(part(k), F.when(k < F.size(parts) - 1, F.get(marks, k)).otherwise(""))), "")
    given = F.lit("")
    for (s, g), names in GIVEN.items():
        given = F.when((script == s) & (gender == g), F.element_at(F.array(*map(F.lit, names)), _number(draw, F.lit(0)) % len(names) + 1)).otherwise(given)
    more = F.transform(F.sequence(F.lit(1), attempt * 2 + 1), lambda i: F.when(i <= attempt * 2, F.element_at(said, _number(draw, i) % 32 + 1)).otherwise(""))
    given = F.concat(F.lower(given), F.array_join(more, ""))
    # An address keeps its country code and its top-level domain is one that is never delegated.
    # A local part that is drawn as it was, or that has nothing to draw, gets two syllables.
    local, was = F.substring_index(F.array_join(chars, ""), "@", 1), F.substring_index(norm, "@", 1)
    two = F.concat(F.element_at(said, _number(draw, F.lit(71)) % 32 + 1), F.element_at(said, _number(draw, F.lit(72)) % 32 + 1))
    email = F.concat(local, F.when(local == was, two).otherwise(""), F.when(attempt > 2, F.array_join(more, "")).otherwise(""), F.lit("@"), F.regexp_replace(F.substring_index(F.array_join(chars, ""), "@", -1), r"[^.]+$", "example"))
    iban = _with_mod97(F.concat(F.substring(norm, 1, 2), F.substring(F.array_join(chars, ""), 3, 60), longer))
    # A card keeps the first digit, which tells its kind of issuer.
    card = _with_luhn(F.concat(F.substring(norm, 1, 1), F.substring(F.array_join(chars, ""), 2, 40), longer))
    return F.when(kind == "name", surname).when(kind == "given", given).when(kind == "ip", F.array_join(octets, ".")).when(kind == "email", email).when(kind == "iban", iban).when(kind == "card", card).otherwise(F.concat(F.array_join(chars, ""), longer))


def _cased(surrogate: Column, like: Column) -> Column:
    """A name word in the case of the one it stands for: all capitals, or a capital at the start of each part."""
    capitals = F.array_join(F.transform(F.split(surrogate, r"(?<=['’-])"), F.initcap), "")
    return F.when((F.char_length(like) > 2) & (F.upper(like) == like), F.upper(surrogate)).otherwise(capitals)


def _laid_out(m: Column, s: Column, given: Column) -> Column:
    """A surrogate's normal form in the format of a mention: separators, brackets, spaces, title and case stay."""
    digits = F.aggregate(
        F.split(m["text"], ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda a, c: F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(a["out"], F.substring(s, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
        lambda a: F.concat(a["out"], F.substring(s, a["k"], F.lit(100))),
    )
    title = F.regexp_extract(m["text"], rf"^({_LEAD})", 1)
    words = F.split(F.substring(m["text"], F.char_length(title) + 1, F.char_length(m["text"])), " ")
    name = F.concat(title, F.array_join(F.zip_with(F.concat(given, F.array(s)), words, _cased), " "))
    return F.when(m["kind"] == "name", name).when(m["kind"].isin("phone", "card", "ssn", "iban"), digits).otherwise(s)


def surrogate_map(entities: DataFrame, key: str, most_rounds: int = 100) -> DataFrame:
    """(kind, norm, script, gender) -> (kind, norm, surrogate), one to one within a kind; no surrogate is a real entity."""
    now = cut(entities.groupBy("kind", "norm").agg(F.max("script").alias("script"), F.coalesce(F.max(F.when(F.col("gender") != "n", F.col("gender"))), F.lit("n")).alias("gender")).withColumn("attempt", F.lit(0)), "entities")
    real = now.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("taken"))
    for _ in range(most_rounds):
        drawn = now.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("norm"), F.col("script"), F.col("gender"), F.col("attempt")))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("first"), F.count("*").alias("n"))
        judged = first.join(real, ["kind", "surrogate"], "left").where("n > 1 or taken")
        again = drawn.join(judged, ["kind", "surrogate"], "left").withColumn("again", F.coalesce(F.col("taken") | (F.col("norm") != F.col("first")), F.lit(False)))
        again = cut(again.select("kind", "norm", "script", "gender", F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), "surrogate", "again"), "drawn")
        if not again.where("again").limit(1).count():
            return again.select("kind", "norm", "surrogate")
        now = again.select("kind", "norm", "script", "gender", "attempt")
    raise RuntimeError(f"surrogates still collide after {most_rounds} rounds")


def replace_personal_data(docs: DataFrame, *, key: str = "strata", id_col: str = "doc_id", text_col: str = "text", learn_from: int = 2) -> DataFrame:
    """One row per input row: id, text with surrogates, n_entities and n_<kind> of each kind.

    Null texts stay null; texts without mentions are unchanged.  Names are found by their titles, or by a given name that
    titles before ``learn_from`` or more surnames taught; other mentions of them in the same text are replaced too.  Only
    titled ones are counted.  Repeated rows come out repeated; an empty table is empty; texts may have any length;
    other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    # Parsed once: the pieces of texts with mentions, and the others as they are.  The row number keeps Catalyst from
    # putting the parse into both columns.
    parsed = rows.select("id", "t", _pieces("t").alias("p"), F.monotonically_increasing_id().alias("row"))
    some = F.exists("p", lambda x: x["mention"].isNotNull()) & F.col("row").isNotNull()
    parsed = cut(parsed.select("id", "row", F.when(some, F.col("p")).alias("p"), F.when(~F.coalesce(some, F.lit(False)), F.col("t")).alias("t")), "parsed")
    split = parsed.where("p is not null").select("id", "row", "p")
    found = split.select("row", F.explode("p").alias("x")).where("x.mention is not null").select("row", "x.mention.*")
    given = found.select("row", F.lit("given").alias("kind"), F.explode("given").alias("norm"), "script", "gender")
    entities = found.select("row", "kind", "norm", "script", "gender").unionByName(given)
    # Untitled persons: runs of name words with a learnt given name before their last word.
    learnt = found.where("kind = 'name'").select(F.explode("given").alias("norm"), F.col("norm").alias("surname")).where("char_length(norm) > 1").groupBy("norm").agg(F.countDistinct("surname").alias("n")).where(F.col("n") >= learn_from).select("norm")
    plain = parsed.select("row", F.explode(F.coalesce(F.transform("p", lambda x: x["after"]), F.array(_escaped(F.col("t"))))).alias("plain"))
    runs = plain.select("row", F.explode(F.regexp_extract_all("plain", F.lit(RUN), F.lit(0))).alias("run")).distinct()
    words = runs.select("row", "run", F.filter(F.split(F.lower("run"), " "), lambda w: ~F.endswith(w, F.lit("."))).alias("w"))
    first = words.select("row", "run", "w", F.posexplode(F.slice("w", 1, F.size("w") - 1)).alias("k", "norm")).join(learnt, "norm").groupBy("row", "run", "w").agg(F.min("k").alias("k"))
    name = F.struct(F.lit("name").alias("kind"), F.element_at("w", -1).alias("norm"))
    givens = F.transform(F.slice("w", F.col("k") + 1, F.size("w") - 1 - F.col("k")), lambda g: F.struct(F.lit("given").alias("kind"), g.alias("norm")))
    script = F.when(F.col("run").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    untold = cut(first.select("row", F.inline(F.concat(F.array(name), givens)), script.alias("script"), F.lit("n").alias("gender")), "untitled")
    entities = entities.unionByName(untold.select("row", "kind", "norm", "script", "gender"))
    drawn = surrogate_map(entities, key)
    per_row = entities.select("row", "kind", "norm").distinct().join(drawn, ["kind", "norm"])
    per_row = per_row.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0000", "kind", "norm"), "surrogate"))).alias("map"), F.bool_or(F.col("kind") == "name").alias("named"))

    def rebuilt(x: Column) -> Column:
        m = x["mention"]
        said = lambda kind, norm: F.element_at(F.col("map"), F.concat_ws("\u0000", kind, norm))
        given = F.transform(m["given"], lambda g: said(F.lit("given"), g))
        return F.concat(F.when(m.isNull(), "").otherwise(_laid_out(m, said(m["kind"], m["norm"]), given)), F.when(F.col("named"), untitled(x["after"])).otherwise(x["after"]))

    def untitled(plain: Column) -> Column:
        """Capitalised words of a text's own persons, where they stand without a title; a given name's initial stays."""
        said = lambda kind, w: F.element_at(F.col("map"), F.concat_ws("\u0000", F.lit(kind), F.lower(w)))
        words = F.split(plain, _EDGES)
        known = F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}.") & w.rlike(r"\p{L}$"), _cased(F.coalesce(said("name", w), said("given", w)), w)).otherwise(F.lit(None).cast("string")))
        return F.array_join(F.zip_with(words, known, lambda w, k: F.coalesce(k, w)), "")

    def counted(kind: str | None) -> Column:
        ok = lambda x: x["mention"].isNotNull() if kind is None else F.coalesce(x["mention"]["kind"] == kind, F.lit(False))
        return F.size(F.filter("p", ok)).cast("long").alias(f"n_{kind or 'entities'}")

    kinds = [None, *KINDS]
    with_any = split.join(per_row, "row").select("id", _unescaped(F.array_join(F.transform("p", rebuilt), "")).alias("t"), *map(counted, kinds))
    # A text without a titled mention is one piece; only the few that have a learnt name meet the map.
    bare = parsed.where("p is null")
    named_rows = untold.select("row").distinct()
    piece = F.array(F.struct(F.lit(None).cast(MENTION).alias("mention"), _escaped(F.col("t")).alias("after")))
    learnt_rows = bare.join(named_rows, "row", "left_semi").select("id", "row", piece.alias("p")).join(per_row, "row").select("id", _unescaped(F.array_join(F.transform("p", rebuilt), "")).alias("t"), *map(counted, kinds))
    clean = bare.join(named_rows, "row", "left_anti")
    with_any = with_any.unionByName(learnt_rows)
    without = clean.select("id", "t", *[F.lit(0).cast("long").alias(f"n_{k or 'entities'}") for k in kinds])
    return with_any.unionByName(without).withColumnsRenamed({"id": id_col, "t": text_col})


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents"))
