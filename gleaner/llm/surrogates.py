"""Surrogates for personal data and secrets. DataFrame functions only.

``pseudonymise`` finds entities in whole texts and puts keyed replacements of the same kind in their place: digits
for digits, letters for letters of the same case, checksums that hold (cards, account numbers), country and
key prefixes kept, names of the same gender and script. A replacement depends on the key and the
entity alone, so an entity has the same one everywhere, however a mention is spaced or cased, and
words of a name are replaced one by one, so that a later mention by surname agrees with the full name.

Cards, account numbers and phone numbers are runs of groups, and the groups behind or before one look alike. Where the
longest run is none, every start and every ending at a group's border is tried, and the text is read again with the
runs that hold; what does not hold takes no neighbour with it.

Collision checks: the distinct entities propose replacements; one that is an entity of the data itself, or
is proposed by several, goes to at most one of them, and the others propose anew until all are distinct.
Only the distinct entities take part, partitioned by replacement; texts are not moved for it, and only
texts with entities are joined with their replacements.

Defined results: null and empty texts stay as they are, with no entity; texts without an entity are returned
unchanged; a secret without a letter or digit (a masked one) is none and stays; numbers whose checksum fails are no cards or account numbers and stay; rows that repeat get
the same text each; an empty table gives an empty result; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.common import stage

# Forms of address by gender, and given names that are recognised without one.
_MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Signor", "Господин", "Κύριος")
_FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Signora", "Госпожа", "Κυρία")
#: Forms of address of either gender: the name that follows tells, by the list below or its last letter.
_EITHER = ("Dr", "Prof", "Doctor", "Professor")
_MALE_GIVEN = ("James John Robert Michael William David Richard Thomas Charles Daniel Matthew Peter Paul Hans Klaus Jürgen Pierre Jean "
               "Jacques Carlos José Juan Luis Иван Сергей Алексей Дмитрий Γιώργος Νίκος").split()
_FEMALE_GIVEN = ("Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Anna Emily Laura Julia Petra Sabine Ursula Marie Sophie "
                 "Claire María Carmen Lucía Анна Елена Ольга Мария Ελένη Μαρία").split()
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SECRET = r"(?i:password|passwd|pwd|secret|token|api_key|apikey|access_key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: What follows such a word in prose: one small English word.
_PROSE = r"[a-z]{1,14}(?:[\s.,;!?]|$)"
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"

#: Kinds and what their mentions look like, tried in this order at each place of a text.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "secret": rf"(?<![A-Za-z])(?=[pPsStTaA])(?:{_SECRET})(?!{_PROSE})[^\s\"',;=:]{{5,}}[^\s\"',;=:.]",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:gh[opsu]_|glpat-|xox[abp]-|sk-(?:live-|test-|proj-)?)(?=[A-Za-z_-]*\d)[A-Za-z0-9_-]{16,255})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    # An address behind a number is no group of it.
    "card": rf"(?<![\w.,+-])\d(?:(?:[ -](?!(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)))?\d){{12,18}}(?![\w])",
    "ip": rf"(?<![\w.])(?<![vV]ersion )(?<![rR]elease )(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    # A group that goes on with a point and a digit belongs to an address, not to the number before it.
    "phone": r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?![\w])"
             r"|(?<![\w+])\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{1,4}(?:[ -]?\d{2,4}(?!\d*\.\d)){1,4}(?![\w])"
             r"|(?<![\w+])\+\d{1,3}(?:\.\d{2,4}){2,4}(?![\w])"
             r"|(?<![\w])\(\d{3}\) ?\d{3}-\d{4}(?![\w])|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:(?:{'|'.join(_MALE + _FEMALE + _EITHER)})\.?\s{_NAME}|(?:{'|'.join(_MALE_GIVEN + _FEMALE_GIVEN)})(?=\s{_NAME}))(?:\s{_NAME}){{0,2}}(?![\p{{L}}\p{{N}}])",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Kinds that are checked after they are found, and what may stand between their groups.
CHECKED = {"iban": "[ ]", "card": "[ -]", "phone": "[ .-]"}
#: Characters of an account number by country.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 "
    "GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 "
    "PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}
_DATE = r"(?:19|20)\d\d-(?:0[1-9]|1[0-2])(?!\d)"
#: Every entity but a name holds one of these characters.
_MARK = "[0-9@=:]"
_MARKED = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "name")
#: Proposals of an entity before the check gives up; the space grows with each for names, addresses and secrets.
MAX_ROUNDS = 100

# Syllables of made-up names, and letters of other scripts that stand for Latin ones.
_ONSETS, _VOWELS = "b d f g k l m n p r s t v z".split(), "a e i o u".split()
_ENDS = {"given_m": ["n", "r", "s", "l", "t"], "given_f": ["a", "na", "la", "ra", "ta"], "surname": ["mer", "ron", "tel", "lin", "dor"]}
#: Letters that stand for letters of a script, small and capital if it has both; other letters become Latin ones.
_LETTERS = {
    "IsCyrillic": ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"), "IsGreek": ("αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")} | {
    f"Is{script}": ("".join(map(chr, range(first, last + 1))),) * 2 for script, first, last in (
        ("Han", 0x4E00, 0x4EFF), ("Hangul", 0xAC00, 0xACFF), ("Hiragana", 0x3042, 0x3093), ("Katakana", 0x30A2, 0x30F3), ("Arabic", 0x0628, 0x063A),
        ("Hebrew", 0x05D0, 0x05EA), ("Devanagari", 0x0915, 0x0939), ("Thai", 0x0E01, 0x0E2E))}
_LATIN, _CYRILLIC, _GREEK = "abdefgiklmnoprstuvz", "абдефгиклмнопрстувз", "αβδεφγικλμνοπρστυβζ"


def _digest(key: str, kind: Column, canonical: Column, turn: Column) -> Column:
    """128 hexadecimal digits from the key and the entity."""
    inner = F.sha2(F.concat(F.lit(key), F.concat_ws("|", kind, turn.cast("string"), canonical)), 256)
    return F.sha2(F.concat(F.lit(key), inner), 512)


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _pick(values: list[str] | str, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), n % len(values) + 1)


def _same_class(text: Column, digest: Column, shift: int = 0, scripts: bool = False) -> Column:
    """Letters for letters of the same case, digits for digits; other characters stay. With ``scripts``, letters and
    digits that are not ASCII are replaced too, letters by those of their script."""
    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i + shift)
        out = F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), F.char(97 + b % 26)).when(
            c.rlike("[A-Z]"), F.char(65 + b % 26))
        if not scripts:
            return out.otherwise(c)
        letter = lambda letters: F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1))
        new = F.when(c.rlike(r"\p{N}"), (b % 10).cast("string"))
        for script, (small, capital) in _LETTERS.items():
            new = new.when(c.rlike(rf"\p{{{script}}}"), F.when(c.rlike(r"\p{Lu}"), letter(capital)).otherwise(letter(small)))
        new = new.when(c.rlike(r"\p{Lu}"), F.char(65 + b % 26)).otherwise(F.char(97 + b % 26))
        return out.when(c.rlike(r"[\p{L}\p{N}]"), new).otherwise(c)
    return F.array_join(F.transform(_chars(text), one), "")


def _hexadecimal(text: Column, digest: Column) -> Column:
    one = lambda c, i: F.substring(F.lit("0123456789abcdef"), _byte(digest, i) % 16 + 1, F.lit(1))
    return F.array_join(F.transform(_chars(text), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of a card number's digits, every second from the right (but the last) doubled."""
    def add(total: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.struct((total["sum"] + F.when(total["n"] % 2 == 1, twice).otherwise(d)).alias("sum"), (total["n"] + 1).alias("n"))
    return F.aggregate(F.reverse(_chars(digits)), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), add, lambda t: t["sum"])


def _mod97(text: Column) -> Column:
    """Remainder of a number written with digits and letters (A is 10)."""
    def add(left: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(c.rlike("[0-9]"), (left * 10 + v - 48) % 97).otherwise((left * 100 + v - 55) % 97)
    return F.aggregate(_chars(text), F.lit(0), add)


def _made_up(kind: str, digest: Column, turn: Column) -> Column:
    """A pronounceable word; later proposals are longer."""
    syllables = F.transform(F.sequence(F.lit(0), F.lit(1) + F.floor(turn / 4).cast("int")), lambda i: F.concat(
        _pick(_ONSETS, _byte(digest, i * 2)), _pick(_VOWELS, _byte(digest, i * 2 + 1))))
    return F.concat(F.array_join(syllables, ""), _pick(_ENDS[kind], _byte(digest, F.lit(60))))


def _proposal(key: str) -> Column:
    """Replacement of (kind, canonical) at its ``turn``."""
    kind, c, turn = F.col("kind"), F.col("canonical"), F.col("turn")
    g = _digest(key, kind, c, turn)
    n = F.length(c)
    tail = lambda k: F.substring(c, F.lit(k + 1), n)
    domain = F.substring_index(c, "@", -1)
    # The last label, or two where the second last only says what kind of holder the country's names have.
    top = F.regexp_extract(domain, r"\.((?:co|com|org|net|ac|gov|edu)\.[a-z]{2}|[A-Za-z]{2,24})$", 1)
    card = F.concat(F.substring(c, 1, 1), _same_class(F.substring(c, F.lit(2), n - 2), g))
    bban = _same_class(tail(4), g)
    country = F.substring(c, 1, 2)
    check = F.lpad((98 - _mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")
    ahead = F.when(c.startswith("+"), F.when(c.startswith("+1"), F.lit(2)).otherwise(F.lit(3))).otherwise(F.lit(0))
    number = F.substring(c, ahead + 1, n)
    first = (2 + _byte(g, F.lit(62)) % 8).cast("string")
    octet = lambda i: ((_byte(g, F.lit(2 * i)) * 256 + _byte(g, F.lit(2 * i + 1))) % 254 + 1).cast("string")
    # Private and loopback addresses stay so, and others become others (first numbers 11 to 110), while there is room.
    near = F.regexp_extract(c, r"^(10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.", 1)
    rest = F.slice(F.array(octet(0), octet(1), octet(2), octet(3)), F.size(F.split(near, r"\.")) + 1, 4)
    far = F.concat_ws(".", (11 + _byte(g, F.lit(40)) % 100).cast("string"), octet(1), octet(2), octet(3))
    address = F.when((near != "") & (turn < 8), F.concat_ws(".", near, F.array_join(rest, "."))).otherwise(far)
    local = F.substring_index(c, "@", 1)
    # Later proposals of addresses and secrets are longer, by letters that a hexadecimal value may hold.
    more = _hexadecimal(F.repeat(F.lit("x"), F.floor(turn / 4).cast("int")), F.sha2(g, 256))
    email = F.concat(_same_class(local, g), more, F.lit("@"), _same_class(F.substring(domain, F.lit(1), F.length(domain) - F.length(top)), g, 31), top)
    head = F.regexp_extract(c, r"^(?:AKIA|ASIA|gh[opsu]_|glpat-|xox[abp]-|sk-(?:live-|test-|proj-)?)", 0)
    script = F.substring_index(kind, "/", -1)
    word = F.lit(None).cast("string")
    for k in _ENDS:
        word = F.when(kind.startswith(k), _made_up(k, g, turn)).otherwise(word)
    word = F.when(script == "cyrillic", F.translate(word, _LATIN, _CYRILLIC)).when(script == "greek", F.translate(word, _LATIN, _GREEK)).otherwise(word)
    return F.when(kind == "email", email).when(kind == "key", F.concat(head, _same_class(F.substring(c, F.length(head) + 1, n), g))).when(
        kind == "secret", F.concat(F.when(c.rlike("^[0-9a-f]+$"), _hexadecimal(c, g)).otherwise(_same_class(c, g, scripts=True)), more)).when(
        kind == "iban", F.concat(country, check, bban)).when(
        kind == "card", F.concat(card, F.pmod(10 - F.pmod(_luhn(F.concat(card, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))).when(
        kind == "ip", address).when(
        kind == "phone", F.concat(F.substring(c, F.lit(1), ahead), first, _same_class(F.substring(number, F.lit(2), F.length(number)), g))).when(
        kind == "ssn", _same_class(c, g)).otherwise(word)


def _holds(kind: str, mention: Column) -> Column:
    """Whether a run that looks like a card, account or phone number is one."""
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    if kind == "card":
        return _luhn(digits) % 10 == 0
    if kind == "phone":
        return F.length(digits).between(7, 15)
    bare = F.regexp_replace(mention, r"[ -]", "")
    return _mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1


def _iban_fits(mention: Column) -> Column:
    """Whether a run is as long as account numbers of its country are; null if that is not known."""
    known = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    return F.length(F.regexp_replace(mention, " ", "")) == F.try_element_at(known, F.substring(mention, 1, 2))


def _doubtful(mention: Column) -> Column:
    """Whether a mention is not what it looks like as a whole, so that a part of it may be."""
    out = F.when(mention.rlike(f"^(?:{PATTERNS['iban']})$"), ~_holds("iban", mention) | ~F.coalesce(_iban_fits(mention), F.lit(True)))
    for kind in ("card", "phone"):
        out = out.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), ~_holds(kind, mention))
    return out.otherwise(F.lit(False))


def _ending(kind: str, run: Column) -> Column:
    """The part from the start of a run to a group's border that holds, or null: the longest, but an account number
    of its country's length, and a phone number without a date behind it, come first."""
    heads = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, F.lit(1), i))
    behind = lambda p: F.substring(run, F.length(p) + 1, F.length(run))
    good = F.filter(heads, lambda p: behind(p).rlike(f"^(?:{CHECKED[kind]}|$)") & p.rlike(f"^(?:{PATTERNS[kind]})$") & _holds(kind, p))
    first = {"iban": lambda p: F.coalesce(_iban_fits(p), F.lit(False)), "phone": lambda p: ~p.rlike(f" {_DATE}") & ~p.rlike(r" (?:19|20)\d\d$")
             | ~run.rlike(f" {_DATE}"), "card": lambda p: F.lit(True)}[kind]
    return F.array_max(F.transform(good, lambda p: F.struct(first(p).alias("first"), F.length(p).alias("n"), p.alias("run"))))["run"]


def _good_runs(text: Column) -> Column:
    """Distinct cards, account and phone numbers of a text from any start, longest first."""
    def endings(kind: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?=({PATTERNS[kind]}))"), F.lit(1)), lambda r: _ending(kind, r))

    runs = [endings(kind) for kind in CHECKED]
    each = F.array_distinct(F.filter(F.concat(*runs), lambda r: r.isNotNull()))
    return F.transform(F.sort_array(F.transform(each, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))), asc=False), lambda x: x["run"])


def _own_pattern(good: Column) -> Column:
    """PATTERN of a text in which only these runs are cards, account and phone numbers; PATTERN itself for null."""
    before = {"iban": "(?<![A-Za-z0-9])", "card": r"(?<![\w.,+-])", "phone": r"(?<![\w+])"}
    starts = {"iban": "^[A-Z]", "card": r"^\d(?:[ -]?\d){12}", "phone": r"^(?!\d(?:[ -]?\d){12})[+(\d]"}

    def quoted(kind: str) -> Column:
        mine = F.transform(F.filter(good, lambda r: r.rlike(starts[kind])), lambda r: F.concat(F.lit(r"\Q"), r, F.lit(r"\E")))
        return F.when(F.size(mine) > 0, F.concat(F.lit(f"(?:{before[kind]}(?:"), F.array_join(mine, "|"), F.lit(r")(?![\w]))")))

    pieces = [quoted(kind) if kind in CHECKED else F.lit(f"(?:{p})") for kind, p in PATTERNS.items()]
    return F.when(good.isNull(), F.lit(PATTERN)).otherwise(F.concat_ws("|", *pieces))


def _parts(mention: Column) -> Column:
    """Entities of a mention: array of (kind, canonical); empty if it is none after all."""
    whole = lambda p: mention.rlike(f"^(?:{p})$")
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    bare = F.regexp_replace(mention, r"[ -]", "")
    entity = lambda kind, c: F.array(F.struct(F.lit(kind).alias("kind"), c.alias("canonical")))
    none = F.array().cast("array<struct<kind:string,canonical:string>>")
    words = F.split(mention, r"\s")
    address = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
    titled = address.isin(*_MALE, *_FEMALE, *_EITHER)
    given = F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    female = address.isin(*_FEMALE, *_FEMALE_GIVEN) | (
        address.isin(*_EITHER) & ~given.isin(*_MALE_GIVEN) & (given.isin(*_FEMALE_GIVEN) | given.rlike("[aаα]$")))
    named = F.when(titled, F.slice(words, 2, 9)).otherwise(words)
    script = F.when(mention.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(mention.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))
    # The last word is the surname, those before are given names.
    name = F.transform(named, lambda w, i: F.struct(
        F.concat(F.when(i == F.size(named) - 1, F.lit("surname/")).when(female, F.lit("given_f/")).otherwise(F.lit("given_m/")), script).alias("kind"),
        F.lower(w).alias("canonical")))
    return F.when(whole(PATTERNS["email"]), entity("email", F.lower(mention))).when(
        whole(PATTERNS["key"]), entity("key", mention)).when(
        whole(PATTERNS["iban"]), F.when(_holds("iban", mention), entity("iban", bare)).otherwise(none)).when(
        whole(PATTERNS["card"]), F.when(_holds("card", mention), entity("card", digits)).otherwise(none)).when(
        whole(PATTERNS["ip"]), entity("ip", mention)).when(
        whole(PATTERNS["phone"]), F.when(_holds("phone", mention), entity("phone", F.concat(
            F.when(mention.startswith("+"), F.lit("+")).otherwise(F.lit("")), digits))).otherwise(none)).when(
        whole(PATTERNS["ssn"]), entity("ssn", digits)).when(
        whole(PATTERNS["secret"]), F.when(
            F.regexp_replace(mention, f"^(?:{_SECRET})", "").rlike(r"[\p{L}\p{N}]"), entity("secret", F.regexp_replace(mention, f"^(?:{_SECRET})", ""))).otherwise(none)).when(
        whole(PATTERNS["name"]), name).otherwise(none)


def _refit(mention: Column, surrogate: Column) -> Column:
    """Letters and digits of a replacement in the places of the mention's, with its case and separators."""
    kept = F.regexp_replace(surrogate, r"[^\p{L}\p{N}]", "")

    def one(c: Column, i: Column) -> Column:
        k = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
        s = F.substring(kept, k, F.lit(1))
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.when(c.rlike(r"\p{Lu}"), F.upper(s)).otherwise(s)).otherwise(c)
    return F.array_join(F.transform(_chars(mention), one), "")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canonical`` (distinct) with ``surrogate``: distinct within a kind, and no entity itself."""
    left = entities.select("kind", "canonical", F.lit(0).alias("turn"))
    given = None
    for turn in range(MAX_ROUNDS):
        offer = stage(left.withColumn("turn", F.lit(turn)).withColumn("surrogate", _proposal(key)), "proposals")
        real = entities.select("kind", F.col("canonical").alias("surrogate"))
        free = offer.join(real, ["kind", "surrogate"], "left_anti")
        if given is not None:
            free = free.join(given.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = stage(free.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")).select(
            "kind", "canonical", "surrogate"), "surrogates")
        given = won if given is None else given.unionByName(won)
        left = offer.join(won, ["kind", "canonical"], "left_anti").select("kind", "canonical", "turn")
        if left.isEmpty():
            return given
    raise ValueError("no distinct surrogates left for some kind of entity")


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """``mention`` (distinct) with ``replacement`` and ``kinds``."""
    parts = stage(mentions.select("mention", _parts(F.col("mention")).alias("parts")), "mentions")
    each = parts.select("mention", F.posexplode("parts").alias("pos", "part")).select(
        "mention", "pos", F.col("part.kind").alias("kind"), F.col("part.canonical").alias("canonical"))
    given = assign(stage(each.select("kind", "canonical").distinct(), "entities"), key)
    found = each.join(given, ["kind", "canonical"]).groupBy("mention").agg(
        F.array_sort(F.collect_list(F.struct("pos", "kind", "surrogate"))).alias("new"))
    first = F.get("new", F.lit(0))
    words = F.split("mention", r"\s")
    titled = F.size(words) > F.size("new")
    said = F.transform(F.when(titled, F.slice(words, 2, 9)).otherwise(words), lambda w, i: F.initcap(F.get(F.col("new"), i)["surrogate"]))
    named = F.array_join(F.when(titled, F.concat(F.slice(words, 1, 1), said)).otherwise(said), " ")
    label = F.regexp_extract("mention", f"^(?:{_SECRET})", 0)
    value = F.substring("mention", F.length(label) + 1, F.length("mention"))
    tail = lambda old, new: F.concat(_refit(old, new), F.substring(new, F.length(old) + 1, F.length(new)))
    part = lambda c, i: F.substring_index(c, "@", i)
    address = F.concat(tail(part(F.col("mention"), 1), part(first["surrogate"], 1)), F.lit("@"), _refit(part(F.col("mention"), -1), part(first["surrogate"], -1)))
    text = F.when(first["kind"].contains("/"), named).when(first["kind"] == "email", address).when(
        first["kind"] == "secret", F.concat(label, tail(value, first["surrogate"]))).when(first["kind"] == "ip", first["surrogate"]).otherwise(
        _refit(F.col("mention"), first["surrogate"]))
    return found.select("mention", text.alias("replacement"), first["kind"].alias("kind"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` rewritten, ``n_replaced`` and ``kinds`` (distinct kinds replaced, in order)."""
    names = docs.columns
    spare = next(f"pii{i}_" for i in range(len(names) + 1) if not any(c.startswith(f"pii{i}_") for c in names))
    text_ = F.col("text")  # the cheap test comes first; it leaves nothing out
    hit = F.coalesce((text_.rlike(_MARK) & text_.rlike(_MARKED)) | text_.rlike(PATTERNS["name"]), F.lit(False))
    # Equal texts have equal entities: each is looked at once.
    read = docs.filter(hit).select("text", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"))
    read = read.select("text", "found", F.when(F.exists("found", _doubtful), _good_runs(text_)).alias("good"))
    again = F.when(F.col("good").isNotNull(), F.regexp_extract_all("text", _own_pattern(F.col("good")), F.lit(0))).otherwise(F.col("found"))
    listed = stage(read.select(F.xxhash64("text").alias("key"), F.length("text").alias("size"), F.struct("good", again.alias("found")).alias("read")).groupBy(
        "key", "size").agg(F.any_value("read").alias("read")).select("key", "size", "read.good", "read.found"), "found")
    spots = listed.select("key", "size", F.posexplode("found").alias("pos", "mention"))
    table = stage(replacements(spots.select("mention").distinct(), key), "replacements")
    kind = F.substring_index("kind", "/", 1)
    lists = spots.join(table, "mention", "left").groupBy("key", "size").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("replacement", "mention").alias("new")))).alias("news"),
        F.count("replacement").alias("n"), F.array_sort(F.collect_set(
            F.when(kind.startswith("given") | (kind == "surname"), F.lit("name")).otherwise(kind))).alias("kinds"))
    # A text read again may hold no entity.
    lists = listed.select("key", "size", "good").join(lists, ["key", "size"], "left").select(
        "key", "size", "good", F.coalesce("news", F.array().cast("array<struct<pos:int,new:string>>")).alias("news"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    lists = lists.select(*(F.col(c).alias(f"{spare}{c}") for c in ("key", "size", "good", "news", "n", "kinds")))
    good = F.col(f"{spare}good")
    pieces = F.when(good.isNull(), F.split("text", PATTERN, -1)).otherwise(F.split("text", _own_pattern(good), -1))
    news = F.concat(F.transform(f"{spare}news", lambda x: x["new"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(pieces, news, lambda a, b: F.concat(a, b)), "")
    out = lambda df, text, n, kinds: df.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names),
                                               n.cast("bigint").alias("n_replaced"), kinds.alias("kinds"))
    found = docs.filter(hit).join(lists, (F.xxhash64("text") == F.col(f"{spare}key")) & (F.length("text") == F.col(f"{spare}size")))
    plain = docs.filter(~hit)
    return out(found, rebuilt, F.col(f"{spare}n"), F.col(f"{spare}kinds")).unionByName(
        out(plain, F.col("text"), F.lit(0), F.array().cast("array<string>")))
