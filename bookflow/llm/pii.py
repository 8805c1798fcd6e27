"""Surrogates for personal data, by DataFrame functions only.

Entities (e-mail addresses, telephone, card (bare digits only with a valid check digit), account and social security numbers, IP addresses, credentials, names of
persons) are found by one pattern. Each distinct entity of the corpus gets a keyed surrogate of its own kind: digits stay digits,
letters keep their case and script, separators stay, card numbers keep their check digit's validity, listed given
names their gender and script. A name is the whole run of capitalised words after a title or listed given name: the last is the
surname, unless it is a listed given name alone ("Mrs. Anna"), the others are given names. Names are replaced word by word, so
"Mrs. Anna Smith" and "Mrs. Smith" keep their common surname. Two entities never share a surrogate, and no surrogate is an entity of the corpus: collisions
get another attempt until there are none.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookflow.llm.common import free_name
from bookflow.settings import stage

# Titles and given names by gender, in Latin and Cyrillic script.
TITLES = {"m": "Mr Herr Monsieur Señor Sr Don Sir Господин", "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Señorita Srta Doña Lady Госпожа",
          "n": "Dr Prof Professor Доктор"}
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Andrew Peter Hans Jürgen Klaus "
         "Wolfgang Heinrich Stefan Jean Pierre François Philippe Nicolas Antoine José Juan Carlos Miguel Javier Pedro "
         "Иван Сергей Дмитрий Алексей Андрей Михаил Николай Владимир",
    "f": "Mary Patricia Jennifer Elizabeth Barbara Susan Jessica Sarah Karen Margaret Emily Anna Laura Ursula Monika Petra Sabine "
         "Claudia Heike Marie Nathalie Isabelle Sophie Camille Céline María Carmen Ana Isabel Lucía Pilar "
         "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана",
}
#: What composes names: syllables, and endings of given names by gender and of family names.
SYLLABLES = {"latin": "ba be bri da del do el fa fer ga gil ha hel ja jo ka ken la len lo ma mel mi na nor pa per ra ro sa sel ta tor va vi wen yo za",
             "cyrillic": "ба бе бри да дел до ел фа га ги ка ла лен ло ма мел ми на нор па ра ро са сел та тор ва ви зо зе"}
ENDINGS = {"latin": {"m": "ard ian us ert", "f": "ina elle etta ia", "n": "in is ey ar", "surname": "berg ford sen well mont ley"},
           "cyrillic": {"m": "ад ор ий ен", "f": "ина ета ия елла", "n": "ан ис", "surname": "енко ский ук чак"}}



def _by_initial(words: str, first: str) -> str:
    """An alternation of the words that begin within a range, tried by their first letter only."""
    own = [w for w in words.split() if re.match(f"[{first}]", w)]
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in own if w[0] == c)})" for c in sorted({w[0] for w in own}))


SCRIPTS = [(r, *(_by_initial(" ".join(x.values()), r) for x in (TITLES, GIVEN))) for r in ("A-Z", "А-Я")]
# A word of a name; a title before another word begins a name of its own.
NAME = r"(?!(?:%s)\.? \p{Lu})\p{Lu}[\p{L}'’\-]++(?!\p{N})" % "|".join(_by_initial(" ".join(TITLES.values()), r) for r in ("A-Z", "А-Я"))
PASSWORDS, CREDENTIALS = "password|passwd|pwd|passphrase", r"token|secret|api[_\-]?key|access[_\-]?key|auth"
LEAD = (rf"(?:{PASSWORDS})[ \t]*+[=:][ \t]*+[\"']?|(?:{CREDENTIALS})[ \t]*+"
        r"(?:=[ \t]*+[\"']?|:[ \t]*+[\"']|:[ \t]*+(?=[A-Za-z]*+(?:[0-9]|[_\-+/.!#$%&*]++[A-Za-z0-9])))")
KINDS = {          # in this order
    # A value of signs alone is masked already; one of letters alone behind a colon may be prose, but for passwords and quotes.
    "secret": r"(?=[pPtTsSaA])(?i:(?<![\p{L}\p{N}])(?:%s))"
              r"(?=[_\-+/.!#$%%&*]*+[A-Za-z0-9])[A-Za-z0-9_\-+/.!#$%%&*]{6,}+|(?=[Ags])(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9_]{20,}+|sk-[A-Za-z0-9_\-]{20,}+)(?![A-Za-z0-9])" % LEAD,
    # A host has at most 127 labels (253 characters).
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*+\.){1,127}[A-Za-z]{2,}+",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?=\d)(?<![\d.+\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|3\d{3}[ \-]\d{6}[ \-]\d{5})(?![\d\-])",
    "phone": r"(?=\+)(?<![\d\p{L}])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)"
             r"|(?=\()(?<![\d\p{L}])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?=\d)(?<![\d\p{L}.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
    "ssn": r"(?=\d)(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "name": "|".join(rf"(?=[{capitals}])(?<![\p{{L}}\p{{N}}])(?:(?:{titles})\.?|{given})(?: {NAME})++"
                     for capitals, titles, given in SCRIPTS),
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: No text without one of these has an entity: nearly every position of a text is passed by one look at its character.
SIGNS, MARKS = "[0-9=:@]", ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
NAMED = "|".join(rf"(?=[{capitals}])(?<![\p{{L}}\p{{N}}])(?:{titles}|{given})\.? " for capitals, titles, given in SCRIPTS)
SECRET_LEAD = rf"^(?i:{LEAD})"
TITLE_LEAD = r"^(?:%s)\.? " % "|".join(" ".join(TITLES.values()).split())


#: Rounds of surrogates of an entity's own length, and of all.
LONGER, ROUNDS = 6, 60


def _lit(p: str) -> Column:
    return F.lit(p)


def found(text: Column) -> Column:
    """All entities of a text, in order."""
    may = reduce(lambda c, m: c | F.contains(text, F.lit(m)), MARKS, F.regexp_like(text, _lit(SIGNS))) | F.regexp_like(text, _lit(NAMED))
    none = F.array().cast("array<string>")
    return F.when(may, F.coalesce(F.regexp_extract_all(text, _lit(PATTERN), F.lit(0)), none)).otherwise(none)


def is_entity(e: Column) -> Column:
    """Not: bare digits that are no card number (time stamps, order numbers), which the pattern finds too."""
    return ~F.regexp_like(e, F.lit(r"^\d{13,19}$")) | (F.pmod(_luhn(e), F.lit(10)) == 0)


def kind_of(e: Column) -> Column:
    out = F.lit("name")
    for kind in ("ssn", "phone", "card", "ip", "iban", "email", "secret"):
        out = F.when(F.regexp_like(e, _lit(f"^(?:{KINDS[kind]})$")), F.lit(kind)).otherwise(out)
    return out


def _any_of(e: Column, words: str) -> Column:
    return F.lower(e).isin([w.lower() for w in words.split()])


def atoms(e: Column) -> Column:
    """What of an entity is replaced as a whole: array of (kind, canon, part): the kind, the form that all
    spellings of one entity share, and the text that is replaced."""
    words = F.split(F.regexp_replace(e, TITLE_LEAD, ""), " ")

    def name(w: Column, i: Column) -> Column:
        script = F.when(F.regexp_like(w, F.lit(r"^\p{IsCyrillic}")), F.lit("cyrillic")).otherwise(F.lit("latin"))
        # Not by the title: a given name that isn't listed has one surrogate with and without.
        own = reduce(lambda c, g: F.when(_any_of(w, GIVEN[g]), F.lit(g)).otherwise(c), "mf", F.lit("n"))
        surname = (i == F.size(words) - 1) & ((F.size(words) > 1) | (own == "n"))
        return F.struct(F.concat_ws("-", F.when(surname, F.lit("surname")).otherwise(F.concat(F.lit("given-"), own)), script).alias("kind"),
                        F.lower(w).alias("canon"), w.alias("part"))

    kind = kind_of(e)
    plain = F.regexp_replace(e, "[^A-Za-z0-9]", "")
    value = F.regexp_replace(e, SECRET_LEAD, "")
    # +1 is the same country as none; of other countries the code stays.
    country = F.when(F.startswith(e, F.lit("+")) & ~F.startswith(e, F.lit("+1")), F.lit("phone-abroad")).otherwise(F.lit("phone"))
    whole = F.struct(F.when(kind == "phone", country).otherwise(kind).alias("kind"),
                     F.when(kind == "secret", value).when(kind.isin("email"), F.lower(e)).when(kind == "ip", e)
                     .when(F.startswith(e, F.lit("+1")), F.substring(plain, F.lit(2), F.length(plain))).otherwise(plain).alias("canon"),
                     F.when(kind == "secret", value).otherwise(e).alias("part"))
    return F.when(kind == "name", F.transform(words, name)).otherwise(F.array(whole))


def _stream(key: str, kind: Column, canon: Column, attempt: Column, n: int = 4) -> Column:
    """64 n hexadecimal digits."""
    return F.concat(*[F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string"), F.lit(str(k))), 256) for k in range(n)])


def _number(stream: Column, i: Column, below: Column | int) -> Column:
    """The i-th number below a bound from a stream (four hexadecimal digits each)."""
    four = F.substring(stream, F.pmod(i, F.lit(64)).cast("int") * 4 + 1, F.lit(4))
    return F.pmod(F.conv(four, 16, 10).cast("int"), F.lit(below) if isinstance(below, int) else below)


def _respell(text: Column, stream: Column, kept: Column, hexadecimal: Column) -> Column:
    """Every digit and letter after the first ``kept`` characters replaced by one of its class."""
    def spell(v: Column) -> Column:
        def pick(letters: str, i: Column) -> Column:
            return F.substring(F.lit(letters), _number(v["stream"], i, len(letters)) + 1, F.lit(1))

        def one(c: Column, i: Column) -> Column:
            return (F.when(i < v["kept"], c).when(c == "0", pick("0123456789", i)).when(c.between("1", "9"), pick("123456789", i))
                    .when(v["hexadecimal"] & c.between("a", "f"), pick("abcdef", i))
                    .when(c.between("a", "z"), pick("abcdefghijklmnopqrstuvwxyz", i))
                    .when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)).otherwise(c))
        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")

    # One element: these are computed once, not for every character of a long value.
    once = F.array(F.struct(stream.alias("stream"), kept.alias("kept"), hexadecimal.alias("hexadecimal")))
    return F.element_at(F.transform(once, spell), 1)


def _luhn(digits: Column) -> Column:
    """The sum that ends in 0 for valid card numbers."""
    n = F.length(digits)

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(F.pmod(n - i, F.lit(2)) == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), value), F.lit(0), lambda a, x: a + x)


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The attempt's surrogate of an entity, in canonical form."""
    s = _stream(key, kind, canon, attempt)
    never, zero = F.lit(False), F.lit(0)
    # Where a form has no free surrogate left, longer ones begin.
    extra = F.when(attempt < LONGER, F.lit("")).otherwise(F.array_join(F.transform(
        F.sequence(F.lit(0), attempt - LONGER + 2), lambda i: _number(s, i + 32, 10).cast("string")), ""))
    spelt = _respell(canon, s, F.when(kind.isin("phone-abroad", "iban"), 2).when(kind == "card", 1)
                     .when((kind == "secret") & F.startswith(canon, F.lit("AKIA")), 4).otherwise(0),
                     (kind == "secret") & F.regexp_like(canon, F.lit("^[0-9a-f]+$")))
    spelt = F.concat(spelt, extra)
    head = F.substring(spelt, F.lit(1), F.length(spelt) - 1)
    check = F.pmod(10 - F.pmod(_luhn(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn(canon), F.lit(10)) == 0, F.concat(head, check)).otherwise(spelt)
    local, host = F.split_part(canon, F.lit("@"), F.lit(1)), F.split_part(F.split_part(canon, F.lit("@"), F.lit(2)), F.lit("."), F.lit(1))
    # Reserved names for examples: a surrogate address is nobody's.
    email = F.concat(_respell(local, s, zero, never), extra, F.lit("@"), _respell(host, F.reverse(s), zero, never), F.lit(".example.org"))
    ip = F.array_join(F.transform(F.split(canon, r"\."), lambda o, i: (_number(s, i, 254) + 1).cast("string")), ".")

    def syllables(script: str, ending: str) -> Column:
        own, last = SYLLABLES[script].split(), ENDINGS[script][ending].split()
        stem = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 1), lambda i: F.element_at(
            F.array(*map(F.lit, own)), _number(s, i, len(own)) + 1)), "")
        return F.concat(stem, F.element_at(F.array(*map(F.lit, last)), _number(s, F.lit(60), len(last)) + 1))

    out = F.when(kind == "card", card).when(kind == "email", email).when(kind == "ip", ip)
    for script in SYLLABLES:
        for g in "mfn":
            out = out.when(kind == f"given-{g}-{script}", syllables(script, g))
        out = out.when(kind == f"surname-{script}", syllables(script, "surname"))
    return out.otherwise(spelt)


def _placed(kind: Column, part: Column, new: Column) -> Column:
    """A surrogate in the spelling of the replaced text: its separators, or its capitals."""
    new = F.when((kind == "phone") & F.startswith(part, F.lit("+1")), F.concat(F.lit("1"), new)).otherwise(new)
    ordinal = lambda i: F.length(F.regexp_replace(F.substring(part, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
    grouped = F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), lambda c, i: F.when(
        F.regexp_like(c, F.lit("[A-Za-z0-9]")), F.substring(new, ordinal(i), F.lit(1))).otherwise(c)), "")
    grouped = F.concat(grouped, F.substring(new, ordinal(F.length(part)) + 1, F.length(new)))
    named = F.when((F.length(part) > 1) & (F.upper(part) == part), F.upper(new)).otherwise(F.initcap(new))
    return (F.when(kind.startswith("given") | kind.startswith("surname"), named)
            .when(kind.isin("email", "ip", "secret"), new).otherwise(grouped))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, new): distinct surrogates for distinct entities (columns kind, canon).

    Every round proposes one for each entity left; of equal proposals the first entity by hash keeps it, unless it is taken
    or an entity itself. Rounds are written to the shared folder; nearly all entities end in the first. After LONGER rounds surrogates
    grow, so that every form ends; if a key and an entity should still not, that is an error after ROUNDS.
    """
    known = stage(entities.select("kind", "canon").distinct(), "entities")
    left, done, attempt = known, None, 0
    while attempt < ROUNDS:
        first = Window.partitionBy("new").orderBy(F.xxhash64("kind", "canon"), "kind", "canon")
        offered = (left.withColumn("new", surrogate(key, F.col("kind"), F.col("canon"), F.lit(attempt)))
                   .withColumn("place", F.row_number().over(first)))
        clash = known.select(F.col("canon").alias("new")).distinct().withColumn("real", F.lit(True))
        offered = offered.join(clash, "new", "left")
        if done is not None:
            offered = offered.join(done.select("new", F.lit(True).alias("used")), "new", "left")
        else:
            offered = offered.withColumn("used", F.lit(None).cast("boolean"))
        offered = stage(offered.withColumn("kept", (F.col("place") == 1) & F.col("real").isNull() & F.col("used").isNull()), "surrogates")
        kept = offered.where("kept").select("kind", "canon", "new")
        done = kept if done is None else done.unionByName(kept)
        left = offered.where("NOT kept").select("kind", "canon")
        if left.isEmpty():
            return done
        attempt += 1
    raise RuntimeError(f"pii: entities without a surrogate of their own after {ROUNDS} rounds")


def replace_entities(docs: DataFrame, key: str, text: str = "text", n_entities: str = "n_entities") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced by its surrogate under ``key``, and the number of entities.

    The same entity has the same surrogate in all documents and spellings, different entities have different ones.
    Texts without entities are unchanged; null texts stay null and have none; empty texts stay empty. All other columns
    are kept (a column ``n_entities`` of the input gives way). Repeated rows come out repeated, an empty table stays empty.

    Texts with entities are written once to the shared folder; only they and their entities are shuffled. An entity that a third of all
    documents hold is one row of the entity table; the join that brings its surrogate back is split by AQE.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == n_entities.lower()])
    hit, row, list_, pairs_ = free_name(docs, "_hit", "_row", "_atoms", "_pairs")
    marked = docs.withColumn(hit, found(docs[text]))
    holds = F.exists(hit, is_entity)
    clean = marked.where(~holds).drop(hit).withColumn(n_entities, F.lit(0))
    none = F.array().cast("array<struct<kind:string,canon:string,part:string>>")
    dirty = stage(marked.where(holds).withColumn(row, F.monotonically_increasing_id())
                  .withColumn(list_, F.transform(hit, lambda e: F.when(is_entity(e), atoms(e)).otherwise(none))), "texts-with-entities")
    each = dirty.select(row, F.explode(F.array_distinct(F.flatten(list_))).alias("a")).select(row, "a.kind", "a.canon", "a.part")
    table = surrogates(each.select("kind", "canon"), key)
    new = each.join(table, ["kind", "canon"]).groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(
        F.struct("kind", "part").alias("k"), _placed(F.col("kind"), F.col("part"), F.col("new")).alias("v")))).alias(pairs_))

    def spelt(e: Column, own: Column) -> Column:
        """The entity with its atoms replaced: they end it, before them may stand a title or a credential's name."""
        size = F.aggregate(own, F.lit(-1), lambda n, a: n + F.length(a["part"]) + 1)
        lead = F.substring(e, F.lit(1), F.length(e) - size)
        return F.when(F.size(own) == 0, e).otherwise(F.concat(lead, F.array_join(F.transform(own, lambda a: F.element_at(F.col(pairs_), F.struct(a["kind"], a["part"]))), " ")))

    between = F.split(F.col(text), PATTERN, -1)
    fresh = F.zip_with(F.col(hit), F.col(list_), spelt)
    whole = F.array_join(F.flatten(F.zip_with(between, fresh, lambda b, e: F.array(b, F.coalesce(e, F.lit(""))))), "")
    mended = (dirty.join(new, row).withColumn(n_entities, F.size(F.filter(hit, is_entity))).withColumn(text, whole)
              .select(*docs.columns, n_entities))
    return clean.unionByName(mended)
