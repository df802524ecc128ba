"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Numbers (phones, cards, IP addresses, social security numbers) are put in a secret order by a keyed Feistel network
over their digits, and each gets the next one in that order. So equal entities get equal surrogates everywhere,
different ones different ones, and none keeps its own. Their format, leading digits and check digits hold, as does the
first part of an IP address, by which private ones stay private. E-mail addresses and names get surrogates from a
keyed hash, names by part, in the same script, given names with an ending of the gender that the form of address or
else the name's own ending tells. As hashes may meet, a check over the whole corpus looks for two addresses or name
parts with one surrogate, or one that is its own; if there is any, the next nonce is taken for all.

A name is found after a form of address or an introduction ("my name is"), and then wherever one of its words stands
in the same text, in capitals too. A word that any text has (articles, pronouns, auxiliaries and the like) is no name;
nor is the second of two words if the text has it in lower case or after an article elsewhere, so "Herr Müller Haus"
with "das Haus" further on is Herr Müller alone. Names in texts that introduce nobody are not found, and of a noun that
stands behind a surname and has no article anywhere nothing tells that it is none: that would take a trained model.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandway.llm.matching import hits, let
from strandway.llm.scratch import clear, stage

# Patterns of the kinds, in order of precedence.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: With a country code, in the groupings that are in use; ten digits in three groups; with a leading 0, pairs or a
#: dialling code.
NATIONAL = (
    r"\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}", r"\d(?: \d{2}){4}", r"\d{1,2}[ .-]\d{3}[ .-]\d{4}", r"\d{2}(?:[ .-]\d{3}){2}", r"\d{2,4}[ .-]\d{5,8}", r"\d{3}[ .-]\d{3}(?:[ .-]\d{2}){2}", r"\d{7,12}"
)
PHONE = (
    rf"(?<![\w+])\+\d{{1,3}}[ .-]?(?:{'|'.join(NATIONAL)})(?!\d)|(?<![\d(-])(?:\(\d{{3}}\) ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}(?!\d)"
    r"|(?<![\w.,+-])(?:0[1-9](?:[ .]\d{2}){4}|0[1-9]\d{1,3}[ /-]\d{5,8})(?![\w-])"
)
#: Country codes of one and two digits; the others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Digits with single blanks or hyphens, as far as they go; groupings of card numbers; the longest number from a group on.
RUN = r"(?<!\d)\d(?:[ -]?\d){12,}+"
GROUPED = (r"\d{13,19}", r"\d{4}(?:[ -]\d{4}){3}[ -]\d{3}", r"\d{6}[ -]\d{13}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{5}", r"\d{4}[ -]\d{6}[ -]\d{4}", r"\d{4}(?:[ -]\d{4}){2}[ -]\d")
LOOSE = (r"\d(?:[ -]?\d){12,18}",)
MALE = "Mr|Mister|Sir|Lord|Herr|Hr|Señor|Sr|Monsieur|Signor|Господин|Г-н|Κύριος"
FEMALE = "Mrs|Ms|Miss|Madam|Lady|Frau|Señora|Señorita|Sra|Srta|Madame|Mademoiselle|Mme|Mlle|Signora|Госпожа|Г-жа|Κυρία"
EITHER = "Dr|Doctor|Doktor|Docteur|Prof|Professor|Professeur|Profesor|Profesora|Доктор|Профессор"
INTRODUCED = "my name is|My name is|mein Name ist|Mein Name ist|ich heiße|Ich heiße|je m'appelle|Je m'appelle|mon nom est|Mon nom est|me llamo|Me llamo|mi nombre es|Mi nombre es|меня зовут|Меня зовут|με λένε|Με λένε|Full name:|full name:"
TITLES = rf"(?:(?:{MALE}|{FEMALE}|{EITHER})\.? )"
NAME_WORD = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]+(?:['’-]\p{Lu}[\p{L}\p{M}]+)*"
NAME = rf"(?<![\p{{L}}\p{{M}}])(?:(?:{INTRODUCED}) {TITLES}*|{TITLES}+){NAME_WORD}(?: {NAME_WORD})?"
#: What stands before the name, and whether that ends with a form of address.
LEAD, TITLED = rf"^(?:(?:{INTRODUCED}) )?{TITLES}*", rf"(?:^| )(?:{MALE}|{FEMALE}|{EITHER})\.? $"
ARTICLES = "the|a|an|der|die|das|den|dem|des|ein|eine|einen|einem|einer|eines|le|la|les|un|une|el|los|las|una|unos|unas"
ORDINARY = (
    "the a an this that these those it he she we they you i my our your his her its their there here who what when where why how if and but or so as at by for from in of on to with"
    " will would can could shall should may might must do does did is are was were be have has had not no please yesterday today tomorrow then now however also"
    " der die das den dem des ein eine einen einem einer und oder aber wenn als wir ihr sie er es ich du nicht kein keine mit von zu bei nach aus auf für im am um gestern heute dann jetzt bitte"
    " le les un une du et ou mais si il elle nous vous ils elles je tu ce cette ces mon ma mes notre votre son sa ses dans avec pour par sur hier demain puis"
    " el los las y pero ella nosotros ustedes ellos yo este esta estos mi su sus en con para por sobre de del ayer hoy luego"
).split()
KINDS = ("email", "ip", "ssn", "phone", "card", "name")
BEFORE, AFTER = ("|".join(f"(?:{p})" for p in ps) for ps in ((EMAIL, IPV4, SSN), (PHONE, NAME)))
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"
#: Script: consonants, vowels, endings of male and of female given names.
SCRIPTS = {"Cyrillic": ("бвгдзклмнпрстфхч", "аеиоу", "ий", "ия"), "Greek": ("βγδζθκλμνπρστφχψ", "αειοω", "ος", "ία"), "Latin": ("bcdfghklmnprstvz", "aeiou", "on", "ia")}
ROUNDS = 8


def _number(text: Column, modulus: Column) -> Column:
    """A number below the modulus from the hash of a text."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), modulus)


def _permuted(left: Column, right: Column, m_left: Column, m_right: Column, salt: Column) -> Column:
    """The next pair below (m_left, m_right) in a keyed order: alternating Feistel rounds give a pair's place, one is
    added, and the rounds are taken back. That is a permutation which moves every pair."""

    def turn(sign: int):
        def step(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            other = F.when(even, s["l"]).otherwise(s["r"])
            own = F.when(even, s["r"]).otherwise(s["l"])
            modulus = F.when(even, m_right).otherwise(m_left)
            new = F.pmod(own + sign * _number(F.concat_ws("|", salt, i, other), modulus), modulus)
            return F.struct(F.when(even, s["l"]).otherwise(new).alias("l"), F.when(even, new).otherwise(s["r"]).alias("r"))

        return step

    zero = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), zero, turn(1))
    after = let(place, lambda p: F.struct(F.pmod(p["l"] + F.when(p["r"] + 1 == m_right, 1).otherwise(0), m_left).alias("l"), F.pmod(p["r"] + 1, m_right).alias("r")))
    return F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1)), after, turn(-1))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _tens(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _permuted_digits(digits: Column, salt: Column) -> Column:
    """Two to eighteen digits as another number of as many."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    pair = _permuted(F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, n).cast("long"), _tens(half), _tens(n - half), F.concat_ws("|", salt, n))
    return let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), n - half, "0")))


def _refilled(x: Column, digits: Column) -> Column:
    """``x``, which has a digit, with its digits replaced in order."""

    def at(own: Column, i: Column) -> Column:
        c = F.substring(x, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(own, F.length(_digits(F.substring(x, F.lit(1), i))), F.lit(1))).otherwise(c)

    return let(digits, lambda own: F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: at(own, i)), ""))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits that stand left of a check digit, modulo 10."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda s, d: s + d) % 10


def is_card(x: Column) -> Column:
    d = _digits(x)
    n = F.length(d)
    return d.rlike(CARD_PREFIX) & ((_luhn(F.substring(d, F.lit(1), n - 1)) + F.substring(d, n, F.lit(1)).cast("int")) % 10 == 0)


def _letters(text: Column, n: int) -> Column:
    """n letters a-p of the hash of a text, four bits each."""
    return F.translate(F.substring(F.sha2(text, 256), 1, n), "0123456789abcdef", "abcdefghijklmnop")


def _syllables(text: Column, n: int, consonants: Column, vowels: Column) -> Column:
    digest = F.sha2(text, 256)

    def one(i: Column) -> Column:
        byte = F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return F.concat(F.substring(consonants, F.pmod(byte, F.lit(16)) + 1, F.lit(1)), F.substring(vowels, F.pmod(F.floor(byte / 16).cast("int"), F.lit(5)) + 1, F.lit(1)))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one), "")


def _script(x: Column, k: int) -> Column:
    return F.when(x.rlike(r"[А-Яа-я]{2}"), F.lit(SCRIPTS["Cyrillic"][k])).when(x.rlike(r"[Α-Ωα-ω]{2}"), F.lit(SCRIPTS["Greek"][k])).otherwise(F.lit(SCRIPTS["Latin"][k]))


def _surname(x: Column, salt: Column) -> Column:
    """Eight syllables of the script."""
    return F.initcap(_syllables(F.concat_ws("|", salt, F.lit("surname"), F.lower(x)), 8, _script(x, 0), _script(x, 1)))


def _given(x: Column, female: Column, salt: Column) -> Column:
    """Five syllables of the script with the gender's ending."""
    seed = F.concat_ws("|", salt, F.lit("given"), female.cast("string"), F.lower(x))
    return F.concat(F.initcap(_syllables(seed, 5, _script(x, 0), _script(x, 1))), F.substring(_script(x, 0), _number(seed, F.lit(16)).cast("int") + 1, F.lit(1)), F.when(female, _script(x, 3)).otherwise(_script(x, 2)))


def _mail(low: Column, salt: Column) -> Column:
    domain = F.substring_index(low, "@", -1)
    return F.concat(_letters(F.concat_ws("|", salt, F.lit("email"), low), 16), F.lit("@"), _letters(F.concat_ws("|", salt, F.lit("domain"), domain), 12), F.lit(".example."), F.substring_index(domain, ".", -1))


def _alone(word: Column) -> Column:
    """The pattern of a word on its own."""
    return F.concat(F.lit(r"(?<![\p{L}\p{M}])"), word, F.lit(r"(?![\p{L}\p{M}])"))


def people(text: Column) -> Column:
    """given (null with a form of address and one word), surname (null with an introduction and one word) and female of
    each mention that the pattern of names finds in a text and that isn't an ordinary word."""

    def one(x: Column) -> Column:
        lead, words = F.regexp_extract(x, LEAD, 0), F.split(F.regexp_replace(x, LEAD, ""), " ")
        titled, second = lead.rlike(TITLED), F.get(words, F.lit(1))
        common = F.rlike(text, _alone(F.lower(second))) | F.rlike(text, F.concat(F.lit(rf"(?<![\p{{L}}\p{{M}}])(?i:{ARTICLES}) "), second, F.lit(r"(?![\p{L}\p{M}])")))
        two = (F.size(words) > 1) & ~F.lower(second).isin(ORDINARY) & ~common
        given = F.when(two | ~titled, words[0])
        female = F.when(lead.rlike(rf"(?:^| )(?:{FEMALE})\.? "), True).when(lead.rlike(rf"(?:^| )(?:{MALE})\.? "), False).otherwise(given.rlike("[aаяαη]$"))
        found = F.struct(given.alias("given"), F.when(two, second).when(titled, words[0]).alias("surname"), female.alias("female"), (~titled).alias("bare"))
        return F.when(~F.lower(words[0]).isin(ORDINARY), found)

    return F.filter(F.transform(hits(text, NAME), one), lambda p: p.isNotNull())


def _same(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def _female(x: Column, known: Column) -> Column:
    """The gender of a given name: of the text's mentions of it, one with a form of address goes first."""
    own = F.filter(known, lambda p: _same(p["given"], x))
    titled = F.filter(own, lambda p: ~p["bare"])
    return F.coalesce(F.try_element_at(titled, F.lit(1))["female"], F.try_element_at(own, F.lit(1))["female"], x.rlike("[aаяαηAАЯΑΗ]$"))


def _is_known(x: Column, known: Column) -> Column:
    """Whether the first word of a mention is part of a name of the text."""
    first = F.split(F.regexp_replace(x, LEAD, ""), " ")[0]
    return F.exists(known, lambda p: F.coalesce(_same(p["given"], first), F.lit(False)) | F.coalesce(_same(p["surname"], first), F.lit(False)))


def _name(x: Column, salt: Column, known: Column) -> Column:
    """What leads to the name stays, and so does a second word that is no part of it; one word alone is a given name
    where the text has it as one. Words in capitals stay in capitals."""
    cased = lambda new, w: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(new)).otherwise(new)

    def made(parts: Column) -> Column:
        first, second, lead = parts["words"][0], F.get(parts["words"], F.lit(1)), parts["lead"]
        given = lambda w: cased(_given(w, _female(w, known), salt), w)
        surname = lambda w: cased(_surname(w, salt), w)
        pair = (F.size(parts["words"]) > 1) & F.exists(known, lambda p: F.coalesce(_same(p["given"], first) & _same(p["surname"], second), F.lit(False)))
        alone = F.when(~lead.rlike(TITLED) & F.exists(known, lambda p: _same(p["given"], first)), given(first)).otherwise(surname(first))
        return F.concat(lead, F.when(pair, F.concat_ws(" ", given(first), surname(second))).otherwise(F.concat_ws(" ", alone, second)))

    return let(F.struct(F.regexp_extract(x, LEAD, 0).alias("lead"), F.split(F.regexp_replace(x, LEAD, ""), " ").alias("words")), made)


def kind_of(x: Column) -> Column:
    """The kind of a match of ``pattern_for``."""
    return (
        F.when(x.contains("@"), "email")
        .when(x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "ip")
        .when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(x.rlike(r"^\p{L}"), "name")
        .when(x.rlike(r"^[+(]|^\d{3}[ .-]\d{3}[ .-]\d{4}$|^0\d{1,4}[ ./-]\d"), "phone")
        .when(is_card(x), "card")
    )


def surrogate(x: Column, kind: Column, key: str, nonce: int, known: Column) -> Column:
    """The surrogate of a mention, given the ``people`` of its text."""
    salt = F.lit(f"{key}|{nonce}")
    octets = F.split(x, r"\.")
    of = lambda i: octets[i].cast("long")
    byte = F.lit(256).cast("long")
    # 127 and 10 are private by their first number, 172.16, 192.168 and 169.254 by the second too
    two = octets[0].isin("172", "192", "169")
    near = _permuted(of(2), of(3), byte, byte, F.concat_ws("|", salt, F.lit("ip"), octets[0], octets[1]))
    far = _permuted(of(1), of(2) * 256 + of(3), byte, byte * 256, F.concat_ws("|", salt, F.lit("ip"), octets[0]))
    ip = F.when(two, let(near, lambda p: F.concat_ws(".", octets[0], octets[1], p["l"], p["r"]))).otherwise(
        let(far, lambda p: F.concat_ws(".", octets[0], p["l"], F.floor(p["r"] / 256), F.pmod(p["r"], byte)))
    )

    def number(digits: Column) -> Column:
        """A country code stays whole, of other numbers the first digit, and what is over nine digits."""
        code = F.when(x.startswith("+"), F.length(F.regexp_extract(digits, COUNTRY, 0)))
        keep = F.greatest(F.coalesce(code, F.length(digits) - 9), F.lit(1))
        head = F.substring(digits, F.lit(1), keep)
        return F.concat(head, _permuted_digits(F.substring(digits, keep + 1, F.length(digits)), F.concat_ws("|", salt, kind, head)))

    def card(digits: Column) -> Column:
        prefix, middle = F.substring(digits, F.lit(1), F.lit(4)), F.substring(digits, F.lit(5), F.length(digits) - 5)
        body = F.concat(prefix, _permuted_digits(middle, F.concat_ws("|", salt, F.lit("card"), prefix)))
        return let(body, lambda b: F.concat(b, F.pmod(10 - _luhn(b), F.lit(10)).cast("string")))

    return (
        F.when(kind == "email", _mail(F.lower(x), salt))
        .when(kind == "ip", ip)
        .when(kind == "card", _refilled(x, let(_digits(x), card)))
        .when(kind.isin("phone", "ssn"), _refilled(x, let(_digits(x), number)))
        .when(kind == "name", _name(x, salt, known))
        .otherwise(x)
    )


def pattern_for(text: Column, known: Column) -> Column:
    """The pattern of all kinds, with those card numbers of the text that pass the check digit and the words of its
    known names written out.

    A number may start and end at any group of a run of digits, so one that fails keeps nothing from the numbers inside
    or next to it. Card groupings go before phones, other groupings after them. From one group on, the longest valid
    number of a card grouping is taken; of other groupings only the longest one of up to 19 digits is tried.
    """
    runs = hits(text, RUN)

    def valid(forms: tuple[str, ...]) -> Column:
        """Alternatives '|number|number', '' without any."""
        starts = lambda run: F.concat(*[F.regexp_extract_all(run, F.lit(rf"(?<!\d)(?=({p})(?!\d))"), F.lit(1)) for p in forms])
        numbers = F.array_sort(F.filter(F.array_distinct(F.flatten(F.transform(runs, starts))), is_card), lambda a, b: F.length(b) - F.length(a))
        return F.when(F.size(numbers) > 0, F.concat(F.lit(r"|(?<!\d)(?=\d)(?:"), F.array_join(numbers, "|"), F.lit(r")(?!\d)"))).otherwise("")

    words = F.array_distinct(F.flatten(F.transform(known, lambda p: F.array(F.concat_ws(" ", p["given"], p["surname"]), p["given"], p["surname"]))))
    words = F.array_distinct(F.concat(words, F.transform(words, F.upper)))
    longest = F.array_sort(F.filter(words, lambda w: F.length(w) > 1), lambda a, b: F.length(b) - F.length(a))
    names = F.when(F.size(known) > 0, F.concat(F.lit(r"|(?<![\p{L}\p{M}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{M}])"))).otherwise("")
    cards = F.size(runs) > 0
    return F.concat(F.lit(BEFORE), F.when(cards, valid(GROUPED)).otherwise(""), F.lit("|" + AFTER), F.when(cards, valid(LOOSE)).otherwise(""), names)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, entity and female: the distinct addresses and name parts of all texts, in lower case. Numbers need no check,
    as theirs are a permutation."""
    text = F.col(f"`{text_col}`").cast("string")
    thing = lambda kind, entity, female=None: F.struct(F.lit(kind).alias("kind"), F.lower(entity).alias("entity"), (F.lit(None).cast("boolean") if female is None else female).alias("female"))
    mails = F.transform(F.when(text.contains("@"), hits(text, EMAIL)), lambda x: thing("email", x))
    names = F.flatten(F.transform(people(text), lambda p: F.array(thing("surname", p["surname"]), thing("given", p["given"], p["female"]))))
    empty = F.expr("CAST(array() AS array<struct<kind:string,entity:string,female:boolean>>)")
    return docs.select(F.explode(F.concat(F.coalesce(mails, empty), F.coalesce(names, empty))).alias("x")).select("x.*").where("entity IS NOT NULL").distinct()


def collisions(found: DataFrame, key: str, nonce: int) -> DataFrame:
    """kind, surrogate: surrogates of two different ``entities``, or equal to their own."""
    salt, entity = F.lit(f"{key}|{nonce}"), F.col("entity")
    new = F.when(F.col("kind") == "email", _mail(entity, salt)).when(F.col("kind") == "surname", _surname(entity, salt)).otherwise(_given(entity, F.coalesce("female", F.lit(False)), salt))
    made = found.select("kind", "entity", "female", F.lower(new).alias("surrogate"))
    own = F.struct("entity", "female")
    clash = made.groupBy("kind", "surrogate").agg(F.min(own).alias("a"), F.max(own).alias("b"), F.max(F.col("entity") == F.col("surrogate")).alias("own"))
    return clash.where("NOT a <=> b OR own").select("kind", "surrogate")


def nonce_for(docs: DataFrame, key: str, text_col: str = "text") -> int:
    """The first nonce whose surrogates are all distinct over the corpus. The texts are read once, for their distinct
    entities, on which nonces are tried. Names have some 10**15 surrogates, so more than one try is rare."""
    found = stage(entities(docs, text_col), "entities")
    nonce = next(nonce for nonce in itertools.count() if collisions(found, key, nonce).isEmpty())
    clear(found)
    return nonce


def replace(docs: DataFrame, key: str, text_col: str = "text", nonce: int | None = None) -> DataFrame:
    """The rows of ``docs`` with surrogates in the text, and n_<kind> (long) for each kind.

    A text without personal data is unchanged, a null text stays null with zero counts. Columns of ``docs`` that have
    the names of the counts are replaced, other columns stay whatever their names. Equal rows are treated alike; an
    empty table gives no rows.
    """
    nonce = nonce_for(docs, key, text_col) if nonce is None else nonce
    counts = [f"n_{k}" for k in KINDS]
    rest = [c for c in docs.columns if c not in (text_col, *counts)]
    text = F.col("text")
    out = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("string")).alias("rest"))
    out = out.withColumn("known", people(text)).withColumn("any", pattern_for(text, F.col("known"))).withColumn("hits", F.regexp_extract_all("text", F.col("any"), F.lit(0)))
    kind = lambda x: let(kind_of(x), lambda k: F.when((k != "name") | _is_known(x, F.col("known")), k))
    typed = F.transform("hits", lambda x: F.struct(x.alias("x"), kind(x).alias("kind")))
    out = out.withColumn("typed", F.when(F.size("hits") > 0, typed))
    new = F.transform("typed", lambda t: F.when(t["kind"].isNull(), t["x"]).otherwise(surrogate(t["x"], t["kind"], key, nonce, F.col("known"))))
    pieces = F.zip_with(F.split(text, F.col("any"), -1), new, lambda gap, s: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(s, F.lit(""))))
    out = out.withColumn("text", F.when(F.col("typed").isNotNull(), F.array_join(pieces, "")).otherwise(text))

    def count(kind: str) -> Column:
        return F.when(F.col("typed").isNotNull(), F.size(F.filter("typed", lambda t: t["kind"] == kind))).otherwise(0).cast("long")

    given = [text.alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in counts]
    return out.select(*given, *[count(k).alias(f"n_{k}") for k in KINDS])
