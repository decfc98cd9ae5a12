"""PII surrogates, in DataFrame operations only.

Entities (e-mail addresses, phone, card, account and social-security numbers, IP addresses, secrets, names)
get keyed, type-consistent replacements: same value, same surrogate, in every text. A
surrogate keeps the format of each mention (separators, case, length; cards stay Luhn-valid if they were)
and, for names, the script and the gender that the titles give (several may stand before one name).

Secrets are found by their form, or after a label such as ``password:``. Names are found after titles, labels
and phrases that introduce one, and by common given names; the parts of a text's names are then found alone in
that text, too. Given and family names have surrogates of their own. A given name is of the gender that its
titles agree on.

All distinct entities are listed once. A surrogate that meets another entity's or an original is drawn
again, with the next attempt in the key, until all are distinct, so different people stay different. Names
and addresses grow with the attempts, so there is always room.

Null texts stay null; texts without entities stay as they are; repeated rows get equal texts; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import parts, stored

#: Titles by the gender they give, and syllables that family names are made of.
MALE, FEMALE, NEUTRAL = "Mr|Herr|Monsieur|Señor|Sr|Sir", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Lady", "Dr|Prof"
GIVEN = {"m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Louis Martin Noah Oscar Paul".split(), "f": "Alma Bella Clara Diana Emma Flora Greta Hanna Irene Julia Karla Laura Marie Nora Olga Paula".split(), "n": "Alex Ariel Charlie Dana Eden Jamie Jordan Kim Lee Luca Morgan Nico Robin Sam Sasha Toni".split()}
SYLLABLES = {"latin": "ba den fol gar hen kel lin mor nes pal ras sten tor ven wil zan".split(), "cyrillic": "ба ден фол гар хен кел лин мор нес пал рас стен тор вен вил зан".split()}
GIVEN_CYRILLIC = {"m": "Антон Борис Виктор Глеб".split(), "f": "Анна Вера Дарья Елена".split(), "n": "Женя Саша Валя Слава".split()}

#: Common given names, which show a name where another capitalised word follows.
COMMON = {
    "m": "James John Robert Michael William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Andrew Kenneth George Kevin Brian Edward Ronald Timothy Jason Jeffrey Peter Hans Klaus Jürgen Wolfgang Stefan Pierre Jacques François Philippe Luis José Juan Carlos Miguel Javier Иван Сергей Андрей Дмитрий Алексей".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Michelle Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Ursula Sabine Petra Claudia Nathalie Isabelle Sylvie Carmen Ana Lucía Isabel Мария Ольга Наталья Татьяна Светлана".split(),
}
_TITLES = "|".join((MALE, FEMALE, NEUTRAL))
_WORD = rf"\b(?!(?:{_TITLES})\b)\p{{Lu}}(?:\p{{L}}|['-](?!s\b)(?=\p{{L}}))+(?![\w.%+-]*@)"
_TITLE = rf"\b(?:(?:{_TITLES})\.? )+"
_ONE = r"\b(?:[Mm]y name is |[Dd]ear |(?:[Rr]egards|[Ss]incerely|[Cc]heers),?\s{1,2})"
_TWO = r"\b(?:I am |I'm |[Ss]igned by |(?:[Nn]ame|[Cc]ontact|[Cc]ustomer|[Cc]lient|[Pp]atient|[Ee]mployee|[Aa]uthor|[Ss]igned|[Aa]ttn|[Ff]rom|[Tt]o|[Cc]c) ?: ?)"
_COMMON = r"(?<![\p{L}\p{N}])(?:" + "|".join(n for names in COMMON.values() for n in names) + ")"
_CUE = f"(?:{_TITLE}|{_ONE}|{_TWO})"
_PERSON = f"(?:(?:{_TITLE}|{_ONE}){_WORD}(?: {_WORD})?|{_TWO}{_WORD} {_WORD}|{_COMMON} {_WORD})"
_LABEL = r"""(?<![\p{L}\p{N}])(?i:password|passwd|passphrase|pwd|secret|token|(?:api|access|auth|private|secret)[_ -]?key)\b["']?\s{0,3}[:=]\s{0,3}["']?"""
_LABELLED = _LABEL + r"""(?=[^\s"',;]*(?:[0-9]|[^\w\s"',;.]|\p{Ll}\p{Lu}))[^\s"',;]{5,}[^\s"',;.!?)\]}]"""
_TOKEN = r"(?<![\w-])(?:(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+){1,2})(?![\w-])"
_KINDS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"\b(?=[0-9a-fA-F]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,64}\b",
    "account": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w.]*[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"
    r"|(?<![\w+.,-])(?:\+[1-9][0-9]{8,14}|[2-9][0-9]{9})(?![\w-]|[.,][0-9])",
    "card": r"(?<![\w-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\w-])",
    "token": _TOKEN,
    "name": _PERSON,
}
#: Card before phone, as groups of four digits look like phone numbers.
ORDER = ("email", "secret", "account", "ip", "ssn", "card", "phone", "token", "name")
PATTERN = "|".join(f"(?:{k})" for k in (_LABELLED, *(_KINDS[k] for k in ORDER)))
#: A text without any of these has no entity: a quick test before the pattern.
_SIGNS = rf"[0-9@]|{_CUE}|{_COMMON} |{_LABEL}|(?:[spr]k[-_]|xox[abprs]-|gh[pousr]_|AKIA|AIza|eyJ)"


def pattern_with(people: Column) -> Column:
    """The pattern with a text's own names, given as alternatives, standing alone."""
    return F.when(people == "", F.lit(PATTERN)).otherwise(F.concat(F.lit(PATTERN + r"|(?:(?<![\p{L}\p{N}])(?:"), people, F.lit(r")(?![\p{L}\p{N}]))")))


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for k in reversed(ORDER[:-1]):
        bare = _KINDS[k].replace(r"(?![\w.]*[0-9])", "")
        out = F.when(entity.rlike(f"^(?:{bare})$"), k).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    """What mentions of one thing have in common: digits of numbers, folded addresses, the family name."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "name", F.lower(F.element_at(F.split(entity, " "), -1))).when(kind == "token", entity).otherwise(F.lower(entity))


def _stream(digest: Column, i: Column) -> Column:
    """A number below 4096 for place i, from a digest of 64 hex digits."""
    return F.conv(F.substr(digest, F.pmod(i * 3, F.lit(61)) + 1, F.lit(3)), 16, 10).cast("int")


def _luhn(digits: Column) -> Column:
    """Sum of a digit string without its check digit, as Luhn counts it, mod 10."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    value = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    twice = lambda i: F.pmod(n - i, F.lit(2)) == 0
    return F.aggregate(places, F.lit(0), lambda a, i: a + F.coalesce(F.when(twice(i), F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i)), F.lit(0))) % 10


def surrogate(kind: Column, value: Column, attempt: Column, key: str, gender: Column) -> Column:
    """The replacement of a canonical value at the given attempt; gender (m, f, n) is of given names."""
    digest = F.sha2(F.concat_ws("\u0000", F.lit(key), kind, value, attempt.cast("string")), 256)
    chars = F.split(value, "")
    letter = lambda i, base: F.char(_stream(digest, i) % 26 + base)
    last_dot = F.length(value) - F.length(F.substring_index(value, ".", -1)) - 1
    free = F.when(kind == "email", last_dot).when(kind == "account", F.length(value)).otherwise(F.length(value))

    def swap(c: Column, i: Column) -> Column:
        digit = F.when((i == 0), _stream(digest, i) % 9 + 1).otherwise(_stream(digest, i) % 10).cast("string")
        fixed = (i >= free) | ((kind == "account") & (i < 2))
        hexed = F.substr(F.lit("0123456789abcdef"), _stream(digest, i) % 16 + 1, F.lit(1))
        new = F.when((kind == "secret") & c.rlike("[0-9a-f]"), hexed).when(c.between("0", "9"), digit).when(c.between("a", "z"), letter(i, 97)).when(c.between("A", "Z"), letter(i, 65))
        return F.coalesce(F.when(fixed, c).otherwise(new), c)

    spelled = F.array_join(F.transform(chars, swap), "")
    body = F.substr(spelled, F.lit(1), F.length(spelled) - 1)
    was_valid = (_luhn(F.substr(value, F.lit(1), F.length(value) - 1)) + F.substr(value, F.length(value), F.lit(1)).cast("int")) % 10 == 0
    card = F.when(was_valid, F.concat(body, F.pmod(10 - _luhn(body), F.lit(10)).cast("string"))).otherwise(spelled)
    octets = F.concat_ws(".", *((_stream(digest, F.lit(i)) % 254 + 1).cast("string") for i in range(4)))
    longest = F.least(attempt + 4, F.lit(20))  # 20 draws of three hex digits are all that a digest has
    drawn = lambda names: F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.element_at(F.array(*(F.lit(x) for x in names)), _stream(digest, i) % len(names) + 1))
    made = {s: F.array_join(drawn(names), "") for s, names in SYLLABLES.items()}
    grown = {s: F.array_join(F.slice(drawn(names), 2, F.least(attempt, F.lit(19))), "") for s, names in SYLLABLES.items()}
    first = lambda table: F.lower(reduce(lambda a, b: a.when(gender == b, pick(table[b])), "mf", F.when(F.lit(False), "")).otherwise(pick(table["n"])))
    pick = lambda names: F.element_at(F.array(*(F.lit(x) for x in names)), _stream(digest, F.lit(0)) % len(names) + 1)
    given = F.when(value.rlike(r"\p{IsCyrillic}"), F.concat(first(GIVEN_CYRILLIC), grown["cyrillic"])).otherwise(F.concat(first(GIVEN), grown["latin"]))
    longer = F.array_join(F.transform(F.sequence(F.lit(1), F.least(F.greatest(attempt - 3, F.lit(1)), F.lit(20))), lambda i: letter(i + 1, 97)), "")
    mail = F.when(attempt > 3, F.concat(longer, spelled)).otherwise(spelled)
    name = F.when(value.rlike(r"\p{IsCyrillic}"), made["cyrillic"]).otherwise(made["latin"])
    return F.when(kind == "ip", octets).when(kind == "card", card).when(kind == "name", name).when(kind == "given", given).when(kind == "email", mail).otherwise(spelled)


def mentioned(core: Column, kind: Column, new: Column) -> Column:
    """The surrogate in the format of one mention, or of one of a name's words."""
    before = lambda i: F.length(F.regexp_replace(F.substr(core, F.lit(1), i + 1), "[^0-9]", ""))
    refilled = F.array_join(F.transform(F.split(core, ""), lambda c, i: F.when(c.between("0", "9"), F.substr(new, before(i), F.lit(1))).otherwise(c)), "")
    cased = F.when((core == F.upper(core)) & (kind != "token"), F.upper(new)).when(kind.isin("name", "given"), F.initcap(new)).otherwise(new)
    return F.when(kind.isin("phone", "card", "ssn"), refilled).otherwise(cased)


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, people (the text's names, as alternatives), at, piece, last, lead, core, kind, value, gender: a row
    for every mention, and two for one of a given and a family name. lead is what stays before core."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text").where(F.col("text").rlike(_SIGNS))
    rows = rows.select("*", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("first")).where(F.size("first") > 0)
    person = lambda e: e.rlike(f"^{_PERSON}$")
    named = F.transform(F.filter("first", person), lambda e: F.split(F.regexp_replace(e, f"^{_CUE}", ""), " "))
    known = rows.select("*", named.alias("named"))
    givens = F.transform(F.filter("named", lambda w: F.size(w) > 1), lambda w: F.element_at(w, 1))
    known = known.select("*", givens.alias("givens"), F.transform("named", lambda w: F.element_at(w, -1)).alias("families"))
    words = F.array_union("givens", "families")
    people = F.array_join(F.reverse(F.array_sort(F.array_union(words, F.transform(words, F.upper)))), "|")
    known = known.select("*", people.alias("people"), F.transform(F.array_except("givens", "families"), F.lower).alias("only_given"))
    found = F.when(F.col("people") == "", F.col("first")).otherwise(F.regexp_extract_all("text", pattern_with(F.col("people")), F.lit(0)))
    flat = known.select("doc_id", "row_key", "people", "only_given", F.posexplode(found).alias("at", "entity"))
    e = F.col("entity")
    lead = F.when(person(e), F.regexp_extract(e, f"^{_CUE}", 0)).otherwise(F.regexp_extract(e, f"^{_LABEL}", 0))
    flat = flat.select("*", person(e).alias("person"), lead.alias("lead")).withColumn("core", F.expr("substr(entity, length(lead) + 1)"))
    labelled = (F.col("lead") != "") & ~F.col("person")
    alone = F.when(labelled, "token").when(F.array_contains("only_given", F.lower("core")), "given").otherwise("name")
    plain = kind_of(F.col("core"))
    flat = flat.withColumn("kind", F.when(F.col("person"), "name").when(plain == "name", alone).otherwise(plain))
    has, given = lambda titles: F.col("lead").rlike(rf"\b(?:{titles})\b"), F.lower(F.substring_index("core", " ", 1))
    listed = lambda g: given.isin([n.lower() for n in COMMON[g]])
    gender = F.when(has(MALE), "m").when(has(FEMALE), "f").when(has(NEUTRAL), None).when(F.col("person") & listed("m"), "m").when(F.col("person") & listed("f"), "f")
    piece = lambda i, last, lead, core, kind, gender: F.struct(F.lit(i).alias("piece"), F.lit(last).alias("last"), lead.alias("lead"), core.alias("core"), kind.alias("kind"), canonical(kind, core).alias("value"), gender.alias("gender"))
    none = F.lit(None).cast("string")
    two = F.array(piece(0, False, F.col("lead"), F.substring_index("core", " ", 1), F.lit("given"), gender), piece(1, True, F.lit(" "), F.substring_index("core", " ", -1), F.lit("name"), none))
    pieces = F.when(F.col("person") & (F.instr("core", " ") > 0), two).otherwise(F.array(piece(0, True, F.col("lead"), F.col("core"), F.col("kind"), none)))
    return flat.select("doc_id", "row_key", "people", "at", F.inline(pieces))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """kind, value, new: a distinct surrogate for every distinct entity, none of them an original."""
    said = F.col("gender") if "gender" in found.columns else F.lit(None).cast("string")
    agreed = F.when(F.min("gender") == F.max("gender"), F.min("gender")).otherwise("n")
    # dealt by a fixed number, so that the draws, which are costly, aren't put into a few tasks for their small size
    things = found.select("kind", "value", said.alias("gender")).groupBy("kind", "value").agg(agreed.alias("gender"))
    things = stored(things.repartition(parts(found.sparkSession), "kind", "value"))
    open_, done, attempt = things, None, 0
    taken = things.select(F.col("kind").alias("k"), F.col("value").alias("v"))
    while True:
        drawn = open_.select("kind", "value", surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key, F.col("gender")).alias("new"))
        free = drawn.join(taken, (drawn.kind == taken.k) & (drawn.new == taken.v), "left_anti")
        # one wins each surrogate; an aggregate, so that it is summed up before the shuffle
        won = stored(free.groupBy("kind", "new").agg(F.min("value").alias("value")).select("kind", "value", "new"))
        done = won if done is None else done.unionByName(won)
        w = won.select(F.col("kind").alias("k"), F.col("value").alias("v"))
        open_ = stored(open_.join(w, (open_.kind == w.k) & (open_.value == w.v), "left_anti"))
        if not open_.head(1):
            return done
        attempt += 1
        if attempt > 200:
            raise ValueError("no free surrogates are left for some entities")
        taken = taken.unionByName(won.select(F.col("kind").alias("k"), F.col("new").alias("v")))


def with_surrogates(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """docs, all columns, with text rewritten, and n_entities_."""
    found = stored(entities(docs))
    new = surrogates(found, key).withColumnsRenamed({"kind": "k", "value": "v"})
    met = found.join(new, (found.kind == new.k) & (found.value == new.v))
    put = F.concat("lead", mentioned(F.col("core"), F.col("kind"), F.col("new")))
    said = met.select("doc_id", "row_key", "people", F.struct("at", "piece", "last", put.alias("s")).alias("m"))
    per = said.groupBy(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).agg(F.sort_array(F.collect_set("m")).alias("__new"), F.max("people").alias("__people"))
    keyed = docs.withColumn("__row", F.xxhash64("text"))
    both = keyed.join(per, keyed.doc_id.cast("long").eqNullSafe(per["__id"]) & (keyed["__row"] == per["__key"]), "left")
    both = both.withColumn("__between", F.when(F.col("__new").isNotNull(), F.split("text", pattern_with(F.col("__people")), -1)))
    after = F.flatten(F.transform("__new", lambda m: F.when(m["last"], F.array(m["s"], F.coalesce(F.get("__between", m["at"] + 1), F.lit("")))).otherwise(F.array(m["s"]))))
    text = F.when(F.col("__new").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice("__between", 1, 1), after), ""))
    count = F.coalesce(F.size(F.filter("__new", lambda m: m["last"])), F.lit(0))
    return both.withColumn("text", text).withColumn("n_entities_", F.greatest(count, F.lit(0))).drop("__id", "__key", "__new", "__people", "__between", "__row")


def pii_surrogates(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """doc_id, n_entities, text of every row."""
    return with_surrogates(docs.select("doc_id", "text"), key).select("doc_id", F.col("n_entities_").cast("long").alias("n_entities"), "text")
