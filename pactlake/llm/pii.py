r"""Personal data replaced by surrogates, in DataFrame and SQL operations only.

Entities are e-mail addresses (international domains too), phone numbers in
international form (``+`` or ``00``) or as ``(ddd) ddd-dddd``, IPv4 and IPv6
addresses, card numbers (16 digits in fours, or 14 and 15 in the issuers' groups),
IBANs, and personal names, also in capitals: one or two words after a form of
address, a listed given name with a surname, in either order (``Schmidt, Anna``),
and wherever else in the same text the surnames so found stand. A second word
after a form of address is part of the name unless it is one of the ``ORDINARY``
words. Not detected are names without any of these, and numbers in other national
forms.

The parts that a surrogate is made of are the whole entity, or for names each
word. Each part has a canonical form (lower case; digits only for numbers), and
its surrogate is a keyed function of type and canonical form, so the same address
or name has the same surrogate in all documents, and ``Mrs. Anna Schmidt``,
``Anna Schmidt`` and ``Ms. Schmidt`` stay one person:

* e-mail: letters and digits of the local part and of the domain's labels are
  replaced one by one; the top-level domain and all punctuation stay;
* phone: digits are replaced one by one; country code and layout stay;
* IPv4: octets are replaced by octets from 1 to 254; IPv6: hexadecimal digits are
  replaced one by one;
* card: digits are replaced; a number that passes the Luhn check still does;
* IBAN: country and layout stay, letters and digits are replaced, and the check
  digits are computed anew;
* name: a listed given name becomes another one of the same gender and script, by
  a keyed cycle through the list, so that two never become one; other words are
  replaced letter by letter; forms of address stay.

Upper and lower case follow the original. **Collision checks:** the distinct
parts of the corpus and their surrogates are compared over all documents; a
surrogate that two parts share, or that is itself a part of the corpus, is drawn
again for all but the smallest part until none is left (after ``max_draws`` draws
128 bits of a digest that names the part are added; this breaks the format). Only
parts drawn again are joined back to their documents. Listed given names need no
check among themselves.

Whoever knows the key can compute surrogates; keep it as secret as the data. It
enters plans as the result of a subquery, never as a literal, so that neither the
UI nor event logs show it.

Edge cases: null texts stay null and have no entities; empty texts stay empty;
texts of any length are matched as a whole; rows with a null ``doc_id`` have
their redrawn parts by their text, rows that share a ``doc_id`` share them;
overlapping matches count once, leftmost first; an empty table gives an empty
result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm.common import fresh, stage

#: Given names by gender and script; fixed values.
GIVEN = {
    "female_latin": "anna maria julia laura sofia elena clara emma nina paula sarah lisa katharina sabine monika claire camille isabelle lucia carmen".split(),
    "male_latin": "peter john paul martin david thomas daniel marco felix simon michael andreas stefan jürgen klaus pierre antoine carlos pablo robert".split(),
    "female_cyrillic": "анна мария ольга елена ирина наталья татьяна светлана".split(),
    "male_cyrillic": "иван пётр сергей андрей николай дмитрий павел михаил".split(),
}
#: Capitalised words that begin a sentence rather than end a name; fixed values.
ORDINARY = (
    "The This That These Those He She It We They You His Her Its Our Their There Here Then Now When Where While Who What Why How If But And Or So Yet "
    "Yesterday Today Tomorrow However Also After Before Since Until As At In On Of For From To With Without By Not No Yes Please Thank Thanks "
    "Der Die Das Ein Eine Er Sie Es Wir Ihr Und Oder Aber Gestern Heute Morgen Dann Hier Da Nach Vor Seit Bei Mit Von Zu Nicht "
    "Le La Les Un Une Il Elle Nous Vous Ils Et Ou Mais Hier Puis Ici Avant Depuis Avec Pour"
).split()
#: Forms of address by gender; fixed values.
TITLES = {
    "female": ["Mrs.", "Ms.", "Miss", "Frau", "Mme", "Madame", "Sra.", "Señora", "Г-жа", "Госпожа"],
    "male": ["Mr.", "Herr", "Monsieur", "Señor", "Sr.", "Г-н", "Господин"],
}
#: Country calling codes of one and two digits; all others have three. Fixed values.
CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,24}(?![\p{L}\p{N}])"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
_IP6 = r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_CARD = r"(?<![\p{L}\d])(?:(?:\d{4}[ -]?){3}\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5}|3(?:0[0-5]|[68]\d)\d[ -]?\d{6}[ -]?\d{4})(?!\d)"
_PHONE = r"(?<![\p{L}\d])\+\d(?:[ ./()-]{0,2}\d){7,14}(?!\d)|(?<![\p{L}\d+])00[1-9]\d{0,2}[ ./(-](?:[ ./()-]{0,2}\d){6,13}(?!\d)|(?<![\p{L}\d])\(\d{3}\) \d{3}-\d{4}(?!\d)"
_BOTH = lambda names: "|".join(x.replace(".", r"\.") for n in names for x in dict.fromkeys((n, n.upper())))
_TITLE = _BOTH([t for names in TITLES.values() for t in names])
_LISTED = _BOTH([n.capitalize() for names in GIVEN.values() for n in names])
_WORD = r"\p{Lu}[\p{L}'-]*\p{L}"
_NOT_ORDINARY = rf"(?!(?:{_BOTH(ORDINARY)})(?![\p{{L}}'-]))"
_START = r"(?<![\p{L}'-])(?=\p{Lu})"
_NAME = (
    rf"{_START}(?:{_TITLE}) {_WORD}(?: {_NOT_ORDINARY}{_WORD})?|{_START}(?:{_LISTED}) {_NOT_ORDINARY}{_WORD}|"
    rf"{_START}(?={_WORD}, (?:{_LISTED})(?![\p{{L}}'-])){_NOT_ORDINARY}{_WORD}, \p{{L}}+"
)
ENTITY = "|".join([_EMAIL, _IP, _IP6, _IBAN, _CARD, _PHONE, _NAME])
_ALL_TITLES = [t.lower() for names in TITLES.values() for t in names]


def kind_of(entity: Column) -> Column:
    return (
        F.when(F.contains(entity, F.lit("@")), "email")
        .when(entity.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(F.contains(entity, F.lit(":")), "ip6")
        .when(entity.rlike(r"^(?:[+(]|00[1-9]\d{0,2}[ ./(-])"), "phone")
        .when(entity.rlike(r"^\d"), "card")
        .when(entity.rlike(r"^[A-Z]{2}\d"), "iban")
        .otherwise("name")
    )


def parts_of(entity: Column) -> Column:
    """Canonical parts, each with its kind before a colon: the entity itself, or a name's words but for the form of address."""
    kind = kind_of(entity)
    plain = (
        F.when(kind == "phone", F.regexp_replace(F.concat(F.regexp_extract(entity, r"^\+?", 0), F.regexp_replace(entity, r"\D", "")), "^00", "+"))
        .when(kind == "card", F.regexp_replace(entity, r"\D", "")).when(kind == "iban", F.lower(F.replace(entity, F.lit(" "), F.lit("")))).otherwise(F.lower(entity))
    )
    words = F.filter(F.split(F.lower(entity), "[ ,]+"), lambda w: ~w.isin(*_ALL_TITLES))
    none = F.array().cast("array<string>")
    return F.when(kind == "name", F.transform(words, lambda w: F.concat(F.lit("name:"), w))).when(_is_entity(entity), F.array(F.concat(kind, F.lit(":"), plain))).otherwise(none)


def _is_entity(entity: Column) -> Column:
    """False for what is written like an IBAN and fails its check."""
    account = F.lower(F.replace(entity, F.lit(" "), F.lit("")))
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    return F.when(kind_of(entity) == "iban", _mod97(moved) == 1).otherwise(True)


def cycled(key: str) -> dict[str, str]:
    """Each listed given name's successor in a keyed order of its list."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1]))
    return out


def _with_key(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns ``key`` and ``listed`` (each listed name's surrogate), which plans show as subqueries."""
    held = rows.sparkSession.createDataFrame([(key, cycled(key))], "key string, listed map<string,string>")
    return rows.withColumn("key", held.select("key").scalar()).withColumn("listed", held.select("listed").scalar())


def _draw(canon: Column, attempt: Column) -> Column:
    """64 hex digits that depend on the key (a column), the entity and the draw."""
    return F.sha2(F.concat_ws("|", F.col("key"), canon, attempt.cast("string")), 256)


def _byte(hex_: Column, i: Column) -> Column:
    """The i-th byte of a keyed stream of any length (i from 0)."""
    block = F.sha2(F.concat(hex_, F.floor(i / 32).cast("string")), 256)
    return F.conv(F.substring(block, (2 * F.pmod(i, F.lit(32)) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _letter(character: Column, byte: Column) -> Column:
    """A letter of the character's script."""
    latin = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(byte, F.lit(26)) + 1, F.lit(1))
    cyrillic = F.substring(F.lit("абвгдежзиклмнопрстуфхцчшэюя"), F.pmod(byte, F.lit(27)) + 1, F.lit(1))
    greek = F.substring(F.lit("αβγδεζηθικλμνξοπρστυφχψω"), F.pmod(byte, F.lit(24)) + 1, F.lit(1))
    return F.when(character.rlike(r"\p{IsCyrillic}"), cyrillic).when(character.rlike(r"\p{IsGreek}"), greek).otherwise(latin)


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shape(lowered: Column, hex_: Column, salt: int = 0) -> Column:
    """Letters by letters of their script and digits by digits, one by one."""

    def change(c: Column, i: Column) -> Column:
        byte = _byte(hex_, i + salt)
        return F.when(c.rlike(r"\d"), F.pmod(byte, F.lit(10)).cast("string")).when(c.rlike(r"\p{L}"), _letter(c, byte)).otherwise(c)

    return F.array_join(F.transform(_characters(lowered), change), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one counted once."""
    backwards = _characters(F.reverse(digits))
    values = F.transform(backwards, lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + F.pmod(c.cast("int") * 2, F.lit(10))))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _email(value: Column, hex_: Column) -> Column:
    top = F.substring_index(value, ".", -1)
    body = F.substring(value, F.lit(1), F.length(value) - F.length(top) - 1)
    return F.concat(_shape(body, hex_), F.lit("."), top)


def _ip(value: Column, hex_: Column) -> Column:
    def octet(_, i):
        return (1 + F.pmod(_byte(hex_, 2 * i) * 256 + _byte(hex_, 2 * i + 1), F.lit(254))).cast("string")

    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def _phone(value: Column, hex_: Column) -> Column:
    """``value`` has a plus sign if its country code is given."""
    code = F.regexp_extract(value, rf"^\+(?:{CALLING}|\d{{3}})", 0)
    return F.concat(code, _shape(F.substring(value, F.length(code) + 1, F.length(value)), hex_))


def _card(value: Column, hex_: Column) -> Column:
    def checked(card: Column) -> Column:
        head = F.substring(card, F.lit(1), F.length(card) - 1)
        check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        return F.when(F.pmod(_luhn_sum(value), F.lit(10)) == 0, F.concat(head, check)).otherwise(card)

    return _let(_shape(value, hex_), checked)


def _ip6(value: Column, hex_: Column) -> Column:
    """Groups keep their number of digits, and do not begin with zero if they did not."""

    def change(c: Column, i: Column) -> Column:
        digit = F.lower(F.hex((1 + F.pmod(_byte(hex_, i), F.lit(15))).cast("long")))
        return F.when(c == ":", c).otherwise(digit)

    return F.array_join(F.transform(_characters(value), change), "")


def _mod97(account: Column) -> Column:
    """The remainder of an IBAN's letters and digits, letters as 10 to 35."""
    value = lambda c: F.when(c.rlike(r"\d"), c.cast("int")).otherwise(F.ascii(c) - 87)
    return F.aggregate(_characters(account), F.lit(0), lambda rest, c: F.pmod(F.when(c.rlike(r"\d"), rest * 10).otherwise(rest * 100) + value(c), F.lit(97)).cast("int"))


def _iban(value: Column, hex_: Column) -> Column:
    country = F.substring(value, 1, 2)

    def checked(body: Column) -> Column:
        check = 98 - _mod97(F.concat(body, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)

    return _let(_shape(F.substring(value, F.lit(5), F.length(value)), hex_), checked)


def surrogate(canon: Column, attempt: Column, max_draws: int = 32) -> Column:
    """Canonical surrogate (without its kind) of a canonical part, in rows that have their key."""

    def drawn(canon: Column, hex_: Column) -> Column:
        kind, value = F.substring_index(canon, ":", 1), F.substring(canon, F.instr(canon, ":") + 1, F.length(canon))
        return (
            F.when(kind == "email", _email(value, hex_)).when(kind == "ip", _ip(value, hex_)).when(kind == "ip6", _ip6(value, hex_))
            .when(kind == "phone", _phone(value, hex_)).when(kind == "card", _card(value, hex_)).when(kind == "iban", _iban(value, hex_))
            .otherwise(F.coalesce(F.try_element_at(F.col("listed"), value), _shape(value, hex_)))
        )

    new = _let(canon, lambda c: _let(_draw(c, attempt), lambda h: drawn(c, h)))
    # Past the last draw a digest of the part's own tells the surrogate from all others.
    own = F.substring(_draw(canon, F.lit(-1)), 1, 32)
    apart = F.when(F.contains(new, F.lit("@")), F.concat(own, new)).otherwise(F.concat(new, own))
    return F.when(attempt < max_draws, new).otherwise(apart)


def _dress_word(new: Column, original: Column) -> Column:
    """A name's word in the original's case; after a hyphen or an apostrophe as the original has it."""
    upper = original == F.upper(original)
    letters = F.transform(_characters(new), lambda c, i: F.when(F.substring(original, i + 1, F.lit(1)).rlike(r"^\p{Lu}"), F.upper(c)).otherwise(c))
    same = F.length(new) == F.length(original)
    return F.when(upper & (F.length(original) > 1), F.upper(new)).when(same, F.array_join(letters, "")).otherwise(F.initcap(new))


def _dress(new: Column, original: Column, kind: Column) -> Column:
    """The surrogate in the original's layout and case."""
    digits = F.concat(F.when((kind == "phone") & original.startswith("00"), "00").otherwise(""), F.regexp_replace(new, r"^\+", ""))
    signs = F.when(kind == "iban", F.regexp_replace(original, " ", "")).otherwise(F.regexp_replace(original, r"\D", ""))

    def in_layout(pattern: str, fill: Column) -> Column:
        before = lambda i: F.length(F.regexp_replace(F.substring(original, F.lit(1), i), rf"[^{pattern}]", ""))
        return F.array_join(F.transform(_characters(original), lambda c, i: F.when(c.rlike(f"[{pattern}]"), F.substring(fill, before(i) + 1, F.lit(1))).otherwise(c)), "")

    extra = F.substring(digits, F.length(signs) + 1, F.length(new))
    upper, lower = original == F.upper(original), original == F.lower(original)
    capital = F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1 << 20))
    text = F.when(lower, new).when(upper, F.upper(new)).when(F.substring(original, 1, 1) == F.upper(F.substring(original, 1, 1)), capital).otherwise(new)
    return (
        F.when(kind.isin("phone", "card"), F.concat(in_layout(r"0-9", digits), extra)).when(kind == "iban", F.concat(in_layout("A-Z0-9", F.upper(digits)), extra))
        .when(kind == "ip", new).otherwise(text)
    )


def may_hold(text: Column) -> Column:
    """False for texts that cannot have an entity; much cheaper than the whole pattern."""
    found = text.rlike("[@0-9]|:[A-Fa-f:]")
    for names, after in (*((titles, " ") for titles in TITLES.values()), *(([n.capitalize() for n in given], "") for given in GIVEN.values())):
        for name in names:
            for form in dict.fromkeys((name, name.upper())):
                found = found | F.contains(text, F.lit(form + after))
    return found


def _own_key(id_: Column, text: Column) -> Column:
    """What a row's redrawn parts are kept by: its id, or its text's digest if it has none."""
    return F.when(id_.isNotNull(), F.concat(F.lit("i"), id_.cast("string"))).otherwise(F.concat(F.lit("t"), F.sha2(F.encode(text, "UTF-8"), 256)))


def _mentions(docs: DataFrame) -> DataFrame:
    """``own, canon``: the canonical parts of each row's text, repeats included."""
    found = docs.where(may_hold(F.col("text"))).select(_own_key(F.col("doc_id"), F.col("text")).alias("own"), F.regexp_extract_all("text", F.lit(f"({ENTITY})"), 1).alias("es"))
    return found.select("own", F.explode("es").alias("e")).select("own", F.explode(parts_of(F.col("e"))).alias("canon"))


def entities(docs: DataFrame) -> DataFrame:
    """Distinct canonical parts of all texts."""
    return _mentions(docs).select("canon").distinct()


def redrawn(corpus: DataFrame, key: str, max_draws: int = 32) -> DataFrame:
    """``canon, attempt`` of the parts whose first surrogate cannot stay.

    ``corpus`` is a stored result of :func:`entities`.
    """
    listed = F.col("canon").isin(*[f"name:{n}" for names in GIVEN.values() for n in names])
    kind = F.substring_index(F.col("canon"), ":", 1)
    new = F.concat(kind, F.lit(":"), surrogate(F.col("canon"), F.col("attempt"), max_draws)).alias("new")
    # Listed names take their successor in any case, which is no other part's unless another word was drawn as it.
    drawn = stage(_with_key(corpus.withColumn("attempt", F.lit(0).cast("long")), key).select("canon", "attempt", new), "pii-draws")
    while True:
        # Of a shared surrogate the earliest draw stays, then the smallest entity.
        held = drawn.groupBy("new").agg(F.min(F.struct((~listed).alias("free"), "attempt", "canon")).alias("first"), F.count(F.lit(1)).alias("n"))
        shared = drawn.join(held.where("n > 1"), "new").where(F.col("first.canon") != F.col("canon")).select("canon")
        real = drawn.where(~listed & (F.col("attempt") < max_draws)).join(corpus.select(F.col("canon").alias("new")), "new", "left_semi").select("canon")
        again = stage(shared.unionByName(real).distinct(), "pii-again")
        if again.isEmpty():
            return drawn.where("attempt > 0").select("canon", "attempt")
        following = F.least(F.col("attempt") + 1, F.lit(max_draws).cast("long"))
        retry = _with_key(drawn.join(again, "canon", "left_semi").select("canon", following.alias("attempt")), key).select("canon", "attempt", new)
        drawn = stage(drawn.join(again, "canon", "left_anti").unionByName(retry), "pii-draws")


_KEYS: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key that the session names as ``pactlake.pii.secret``; without one a random key, the same as long as the application lasts.

    Spark redacts settings of that name in logs. Surrogates of two applications
    agree only if both are given the same key.
    """
    named = spark.conf.get("pactlake.pii.secret", None)
    return named or _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def replace(docs: DataFrame, key: str, max_draws: int = 32) -> DataFrame:
    """``docs`` with ``text`` replaced, plus ``n_entities`` (with an underscore before it if ``docs`` has such a column)."""
    corpus = stage(entities(docs), "pii-entities")
    overrides = redrawn(corpus, key, max_draws)
    text = F.col("row.text")
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # clashes with no name below
    attempts = F.create_map().cast("map<string,bigint>")
    if not overrides.isEmpty():
        again = _mentions(docs).distinct().join(stage(overrides, "pii-redrawn"), "canon")
        again = again.groupBy("own").agg(F.map_from_entries(F.collect_list(F.struct("canon", "attempt"))).alias("draws"))
        source = source.withColumn("own", _own_key(F.col("row.doc_id"), text)).join(stage(again, "pii-by-document"), "own", "left")
        attempts = F.coalesce(F.col("draws"), attempts)

    es = F.regexp_extract_all(text, F.lit(f"({ENTITY})"), 1)
    gaps = F.split(text, ENTITY, -1)

    def token(text: Column, kind: Column) -> Column:
        return F.struct(text.alias("text"), kind.alias("kind"))

    nothing = F.lit(None).cast("string")

    def words(entity: Column) -> Column:
        """A name's words, and what stands between them."""
        stays = lambda w: F.lower(w).isin(*_ALL_TITLES) | w.rlike("^[ ,]")
        return F.transform(F.regexp_extract_all(entity, F.lit("([^ ,]+|[ ,]+)"), 1), lambda w: token(w, F.when(~stays(w), "name")))

    def of_entity(entity: Column) -> Column:
        whole = F.array(token(entity, F.when(_is_entity(entity), kind_of(entity))))
        return _let(entity, lambda e: F.when(kind_of(e) == "name", words(e)).otherwise(whole))

    def of_gap(gap: Column) -> Column:
        """What stands between entities, with the names in it that the text has elsewhere."""
        again, around = F.regexp_extract_all(gap, F.col("known"), F.lit(0)), F.split(gap, F.col("known"), -1)
        both = F.flatten(F.zip_with(around, again, lambda a, w: F.when(w.isNull(), F.array(token(a, nothing))).otherwise(F.array(token(a, nothing), token(w, F.lit("name"))))))
        return F.when(F.col("known").isNull() | ~F.rlike(gap, F.col("known")), F.array(token(gap, nothing))).otherwise(both)

    def replaced(t: Column) -> Column:
        """A token with its surrogate. The surrogate's expression stands here alone: plans would grow with every further use."""

        def drawn(canon: Column) -> Column:
            attempt = F.coalesce(F.try_element_at(attempts, canon), F.lit(0).cast("long"))
            dressed = lambda new: F.when(t["kind"] == "name", _dress_word(new, t["text"])).otherwise(_dress(new, t["text"], t["kind"]))
            return _let(surrogate(canon, attempt, max_draws), dressed)

        canon = F.when(t["kind"] == "name", F.concat(F.lit("name:"), F.lower(t["text"]))).otherwise(F.try_element_at(parts_of(t["text"]), F.lit(1)))
        return F.when(t["kind"].isNull(), t["text"]).otherwise(_let(canon, drawn))

    some = may_hold(text) & text.rlike(ENTITY)
    rows = source.withColumn("es", F.when(some, es)).withColumn("gaps", F.when(some, gaps))
    # Surnames of the text, as they stand and in capitals, longest first: a pattern of the row's own.
    spelt = F.flatten(F.transform(F.filter("es", lambda e: kind_of(e) == "name"), lambda e: F.split(e, "[ ,]+")))
    listed = [n for names in GIVEN.values() for n in names]
    spelt = F.array_distinct(F.filter(spelt, lambda w: (F.length(w) > 2) & w.rlike(rf"^{_WORD}$") & ~F.lower(w).isin(*_ALL_TITLES, *listed)))
    spelt = F.reverse(F.array_sort(F.transform(F.array_distinct(F.concat(spelt, F.transform(spelt, F.upper))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    known = F.concat(F.lit(r"(?<![\p{L}\p{N}'-])(?:"), F.array_join(F.transform(spelt, lambda x: x["w"]), "|"), F.lit(r")(?![\p{L}\p{N}-])"))
    rows = _with_key(rows, key).withColumn("known", F.when(F.size(spelt) > 0, known))
    per = F.zip_with("gaps", "es", lambda g, e: F.when(e.isNull(), of_gap(g)).otherwise(F.concat(of_gap(g), of_entity(e))))
    rows = rows.withColumn("tokens", F.when(F.col("es").isNotNull(), F.flatten(per)))
    rows = rows.withColumn("new", F.when(F.col("es").isNull(), text).otherwise(F.array_join(F.transform("tokens", replaced), "")))
    return rows.select(
        *[F.col("new").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns], F.coalesce(F.size(F.filter("es", _is_entity)), F.lit(0)).alias(fresh("n_entities", docs.columns))
    )
