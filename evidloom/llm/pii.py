"""Personal data: base patterns, and boosted trees over the candidates of generators that would rather find too much.

Five generators propose spans, which may overlap each other and base findings: written-out addresses (`ann [at] site dot org`), groups of
digits, plain runs of digits, codes of letters and digits, and groups of hexadecimal digits by colons. Each candidate has format
features (digits, groups, separators, checksums, shapes of dates) and context features (words before it, characters beside it), all small
whole numbers. Trees of DEPTH splits, boosted by the logistic loss, give a score; Platt's method makes a probability of it; a kind's candidates
are kept from its threshold on. What begins inside a base finding, or lies inside a longer span that is kept, is left out; base findings stay.

Training: there is no table of labelled findings, so `findings` makes EXAMPLES of them by rule and seed, secrets of FAMILIES and look-alikes.
Their candidates and features are made by the expressions that scan documents. A second part of them calibrates, a third sets a kind's
threshold: the highest at which each of its families keeps `recall`. The trees are fitted on the driver to the counts of equal feature vectors, a
bounded table; they become column expressions.

Scanning is one pass over the texts in DataFrame functions, row by row, without a shuffle. Places come from the lengths of what stands between
matches. Patterns take runs whole (possessive, behind a look-behind), so a run of any length is read once; sums along a row are made in
chunks of CHUNK, so that many findings in one text cost no quadratic copying.

Defined results: a null text is empty and has no findings; a text of any length is read whole; repeated rows each get a row; no
rows give none; extra columns are ignored.
"""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.common import let, read, rows_with

#: Base patterns (kind, pattern): fixed values of the query. A pattern begins with the character that it needs, then looks behind it, so that no run is read twice; a card's takes whole runs of 13 to 19 digits.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9](?<![0-9].)[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?<![0-9].)(?<![0-9][\x20-].)(?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_AT = r"(?:\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20|\.)"
#: Generators (kind, pattern). Each candidate has at most some 200 characters.
GENERATORS = (
    ("written", rf"[A-Za-z0-9._%+-](?<![A-Za-z0-9._%+-].)[A-Za-z0-9._%+-]{{0,63}}+{_AT}[A-Za-z0-9-]{{1,30}}+(?:{_DOT}[A-Za-z0-9-]{{1,20}}+){{1,4}}"),
    ("grouped", r"(?:[0-9]|\((?=[0-9]))(?<![A-Za-z0-9+@_].)(?<![0-9][./-].)[0-9]{0,5}+\)?(?:(?:[\x20./-]{1,2}|(?<=\)))\(?[0-9]{1,6}\)?){1,5}+(?![A-Za-z0-9@_]|[./-][0-9])"),
    ("digits", r"[0-9](?<![A-Za-z0-9+@_].)(?<![0-9][.,/-].)[0-9]{6,19}+(?![A-Za-z0-9@_]|[.,/-][0-9])"),
    ("code", r"[A-Z](?<![A-Za-z0-9].)[A-Z]{0,2}+\x20?[0-9]{2,9}+(?:[\x20-]?[A-Z0-9]{1,4}){0,8}+(?![A-Za-z0-9])"),
    ("colons", r"(?:[0-9A-Fa-f](?<![A-Za-z0-9:.].)[0-9A-Fa-f]{0,3}+:|:(?<![A-Za-z0-9:.].))[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){1,6}+(?![A-Za-z0-9:])"),
)
#: What a text must hold for a kind to be searched: cheaper to look for.
HOLDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "written": _AT + "[A-Za-z0-9-]{1,30}+" + _DOT + "[A-Za-z0-9-]",
    "grouped": r"[0-9)][\x20./-]{1,2}\(?[0-9]|\)\(?[0-9]", "digits": "[0-9]{7}", "code": r"[A-Z]\x20?[0-9]{2}", "colons": ":[0-9A-Fa-f]{0,4}:",
}
KINDS = tuple(k for k, _ in BASE + GENERATORS)

#: Words that stand before findings, by feature.
WORDS = {
    "w_phone": "phone|tel|telefon|teléfono|téléphone|call|mobile|handy|cell|fax|whatsapp|sms|dial|contact|reach",
    "w_id": "ssn|social security|passport|passeport|reisepass|licen[cs]e|identity|tax id|national|insurance|dni|nif|nino|steuer|patient|member",
    "w_bank": "iban|account|konto|compte|cuenta|bank|card|visa|credit|payment",
    "w_birth": "born|birth|dob|geboren|né le|née le|nacid[oa]",
    "w_net": "ipv6|address|host|server|ping|client|device|mac",
    "w_mail": "e-?mail|contact|write|reach|correo|courriel|kontakt|send",
    "w_other": r"isbn|issn|doi|version|page|order|invoice|build|release|no\.|nr\.|section|chapter|figure|score|room|article|part|item|serial|model|ratio|lines?|years?|between|from",
}
#: Characters of the text before a candidate that are searched for words.
CONTEXT = 32
FEATURES = ("kind", "length", "n_digits", "n_groups", "first", "last", "dots", "hyphens", "spaces", "slashes", "brackets", "zero", "luhn", "mod97", "date", "upper", "lower", "double_colon", "ip_like", "written_at", "written_dot", "gap_dot", "before", "after", *WORDS)

SEED, EXAMPLES, ROUNDS, DEPTH, RATE = 11, 6000, 40, 3, 0.4
RECALL = 0.95
CHUNK = 256


def running(values: Column, start: int, combine) -> Column:
    """combine() over each prefix of an array<bigint>: within chunks of CHUNK, and over the chunks' totals before."""
    last = lambda a, first: F.coalesce(F.get(a, F.size(a) - 1), first)
    along = lambda part, first: F.aggregate(part, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(combine(last(a, first), x))))
    zero = F.lit(start).cast("long")

    def chunked(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda k: F.slice(v, k * CHUNK + 1, CHUNK))
        totals = lambda c: along(F.transform(c, lambda part: F.aggregate(part, zero, combine)), zero)
        return let(chunks, lambda c: let(totals(c), lambda t: F.flatten(F.transform(c, lambda part, k: along(part, F.coalesce(F.get(t, k - 1), zero))))))

    return F.when(F.size(values) > 0, let(values, chunked)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str, holds: str) -> Column:
    """(start, end, hit, left, right) of a pattern's matches in code points: left and right are what stands between it and its neighbours, at most CONTEXT characters of it."""
    length = lambda x: F.char_length(x).cast("long")
    placed = lambda hits, gaps, ends: F.transform(
        hits,
        lambda h, i: F.struct(
            (F.get(ends, i) - length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("hit"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("right"),
        ),
    )
    sums = lambda hits, gaps: running(F.transform(hits, lambda h, i: length(F.get(gaps, i)) + length(h)), 0, lambda a, x: a + x)
    found = lambda hits: let(F.split(text, pattern, -1), lambda gaps: let(sums(hits, gaps), lambda ends: placed(hits, gaps, ends)))
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string,left:string,right:string>>")
    searched = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, found(hits)).otherwise(none))
    return F.when(text.rlike(holds), searched).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(code: Column) -> Column:
    """Of a code of four characters and more: whether it has an account number's check digits."""
    plain = F.regexp_replace(code, "[^A-Z0-9]", "")
    turned = lambda p: F.filter(F.split(F.concat(F.substring(p, 5, 64), F.left(p, F.lit(4))), ""), lambda c: c != "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return let(plain, lambda p: F.when(F.length(p) >= 15, F.aggregate(turned(p), F.lit(0), step) == 1).otherwise(False))


_KEPT = {
    "email": lambda h: F.lit(True),
    "ip": lambda h: h.rlike("^" + r"\.".join([_PART] * 4) + "$"),
    "card": lambda h: luhn(_digits(h)),
    "phone": lambda h: F.length(_digits(h)).between(9, 15),
}
_SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"


def base_findings(text: Column, kind: str, pattern: str) -> Column:
    held = F.filter(matches(text, pattern, HOLDS[kind]), lambda m: _KEPT[kind](m["hit"]))
    number = KINDS.index(kind)
    return F.transform(held, lambda m: F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _features(kind: str, m: Column) -> list[Column]:
    """FEATURES of a candidate, as whole numbers."""
    h, left, right = m["hit"], F.lower(m["left"]), m["right"]
    flag = lambda c: c.cast("int")
    count = lambda pattern: F.regexp_count(h, F.lit(pattern))
    groups = F.filter(F.split(h, "[^A-Za-z0-9]+"), lambda x: x != "")
    made = {
        "kind": F.lit(KINDS.index(kind)),
        "length": F.length(h),
        "n_digits": count("[0-9]"),
        "n_groups": F.size(groups),
        "first": F.length(F.get(groups, F.lit(0))),
        "last": F.length(F.get(groups, F.size(groups) - 1)),
        "dots": count(r"\."),
        "hyphens": count("-"),
        "spaces": count(" "),
        "slashes": count("/"),
        "brackets": count(r"[(\[{<]"),
        "zero": flag(h.rlike(r"^\(?0")),
        "luhn": flag(luhn(_digits(h))) if kind in ("grouped", "digits") else F.lit(0),
        "mod97": flag(_mod97(h)) if kind == "code" else F.lit(0),
        "date": flag(h.rlike(r"^(?:(?:19|20)[0-9]{2}[./-](?:0?[1-9]|1[0-2])[./-](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-](?:19|20)?[0-9]{2})$")),
        "upper": count("[A-Z]"),
        "lower": count("[a-z]"),
        "double_colon": count("::"),
        "ip_like": flag(h.rlike(r"^[0-9]+(?:\.[0-9]+){2,}$")),
        "written_at": flag(h.rlike(r"(?i)[\[({<]\x20?(?:at|@)")),
        "written_dot": flag(h.rlike(r"(?i)[\[({<]\x20?(?:dot|\.)|\x20dot\x20")),
        "gap_dot": flag(h.rlike(r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$")),
        "before": F.when(left.rlike(r"[$€£¥#=]\x20?$"), 2).when(left.rlike(r"[:\x20(\[\"']$|^$"), 1).otherwise(0),
        "after": F.when(right.rlike(r"^\x20?[%$€£¥°]|^\x20?(?:kg|km|cm|mm|pages|people|euros?|dollars?|percent|units|votes)"), 2).when(right.rlike(r"^[.,;!?)\]\"'\s]|^$"), 1).otherwise(0),
        **{k: flag(left.rlike(rf"(?<![a-z])(?:{words})")) for k, words in WORDS.items()},
    }
    return [F.coalesce(made[f].cast("int"), F.lit(0)).alias(f) for f in FEATURES]


def candidates(text: Column) -> Column:
    """(start, end, f: FEATURES) of all generators' candidates."""
    of = lambda kind, pattern: F.transform(
        matches(text, pattern, HOLDS[kind]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.struct(*_features(kind, m)).alias("f"))
    )
    return F.concat(*[of(*g) for g in GENERATORS])


class Trees:
    """Boosted trees: a tree is a value, or (feature, cut, where the feature is at most cut, where it is above)."""

    def __init__(self, trees=(), calibration=(1.0, 0.0), thresholds=None):
        self.trees, self.calibration, self.thresholds = trees, calibration, thresholds or {}

    def kept_sql(self, candidates: str) -> str:
        """SQL for the candidates of an array column whose probability reaches the threshold of their kind; a kind without one keeps nothing. Trees are many small expressions: as text they are made in one call."""

        def value(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{float(tree)!r}D"
            feature, cut, low, high = tree
            return f"CASE WHEN c.f.{feature} <= {cut} THEN {value(low)} ELSE {value(high)} END"

        a, b = self.calibration
        total = " + ".join(map(value, self.trees)) or "0D"
        least = "".join(f" WHEN {KINDS.index(kind)} THEN {t!r}D" for kind, t in self.thresholds.items())
        return f"filter({candidates}, c -> 1D / (1D + exp(-({a!r}D * ({total}) + {b!r}D))) >= CASE c.f.kind{least or ' WHEN -1 THEN 2D'} ELSE 2D END)"


class Maker:
    """Personal data, look-alikes and words around them, by a seed."""

    def __init__(self, seed: int):
        r = self.r = random.Random(seed)
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        n = lambda a, b: str(r.randint(a, b))
        w, pick = self.word, r.choice
        up = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
        phone, ident, bank = ("phone: ", "call ", "tel. ", "mobile ", "Telefon ", "fax: ", "contact "), ("SSN ", "passport ", "license ", "tax id ", "member ", "national number "), ("account ", "IBAN ", "Konto ", "bank: ", "card ", "payment ")
        site, sep = lambda: f"{w()}{pick(['', n(1, 99)])}", lambda: pick([" ", "-", "."])
        tld = lambda: pick(["com", "org", "net", "de", "fr", "es", "io", "info"])
        user = lambda: pick([w(), f"{w()}.{w()}", f"{w()}_{n(1, 99)}", f"{w()}.{n(1, 99)}"])
        colons = lambda k: ":".join(f"{r.randrange(65536):x}" for _ in range(k))
        #: Families of findings: (kind, lead, body).
        self.families = {
            "bracketed_mail": lambda: ("written", pick(["", "mail ", "write to "]), f"{user()}{pick([' [at] ', '[at]', ' (at) ', '(at)', ' {at} ', ' <at> '])}{site()}{pick(['.', ' [dot] ', '[dot]', ' (dot) ', ' dot '])}{tld()}"),
            "spoken_mail": lambda: ("written", pick(["", "email ", "contact "]), f"{user()} {pick(['at', 'AT'])} {site()} {pick(['dot', 'DOT'])} {tld()}"),
            "area_phone": lambda: ("grouped", pick(["", "", *phone]), f"({n(200, 999)}){pick([' ', ''])}{n(200, 999)}{pick(['-', '.', ' '])}{d(4)}"),
            "three_part_phone": lambda: ("grouped", pick(["", *phone]), (s := pick("-. ")).join([n(200, 999), n(200, 999), d(4)])),
            "trunk_phone": lambda: ("grouped", pick(["", *phone]), f"0{n(10, 999)}{pick([' ', '/', '-'])}{d(3)}{sep()}{d(r.randint(2, 4))}{pick(['', ' ' + d(2)])}"),
            "pair_phone": lambda: ("grouped", pick(["", *phone]), (s := sep()).join(["0" + n(1, 9), d(2), d(2), d(2), d(2)])),
            "social": lambda: ("grouped", pick(["", "", *ident]), f"{n(100, 899)}-{n(10, 99)}-{d(4)}"),
            "dotted_card": lambda: ("grouped", pick(["", *bank]), (s := pick("./")).join([c[:4], c[4:8], c[8:12], c[12:]]) if (c := self.card()) else ""),
            "birth": lambda: ("grouped", pick(["born ", "date of birth ", "DOB: ", "geboren am ", "née le ", "nacida el "]), pick([f"{n(1, 28)}{(s := pick('./-'))}{n(1, 12)}{s}{n(1930, 2015)}", f"{n(1930, 2015)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"])),
            "plain_phone": lambda: ("digits", pick(phone), pick(["0", ""]) + n(2, 9) + d(r.randint(7, 10))),
            "plain_id": lambda: ("digits", pick(ident), d(r.randint(8, 11))),
            "plain_account": lambda: ("digits", pick(bank), d(r.randint(8, 12))),
            "iban": lambda: ("code", pick(["", "", *bank]), self.iban(pick([" ", ""]))),
            "document_code": lambda: ("code", pick(ident), up(r.randint(1, 2)) + d(r.randint(6, 8)) + pick(["", up(1)])),
            "insurance_code": lambda: ("code", pick(ident), (s := pick([" ", ""])).join([up(2), d(2), d(2), d(2), up(1)])),
            "six": lambda: ("colons", pick(["", "host ", "address ", "ping ", "from "]), pick([colons(8), f"{colons(r.randint(2, 4))}::{colons(r.randint(1, 3))}", f"fe80::{colons(r.randint(2, 4))}"])),
            "device": lambda: ("colons", pick(["", "MAC ", "device "]), ":".join(f"{r.randrange(256):02x}" for _ in range(6))),
        }
        other = ("ISBN ", "version ", "page ", "order ", "invoice ", "build ", "no. ", "section ", "score ", "item ", "between ", "from ", "model ", "in ", "", "", "")
        #: Look-alikes: (lead, body).
        self.plain = (
            lambda: ("", f"{w()} at {w()}. {w().capitalize()}"),
            lambda: ("", f"{w()} at {w()}.{w()}"),
            lambda: ("look ", f"{w()} (at) {w()}"),
            lambda: ("", f"{w()} at {w()} dot {n(1, 9)}"),
            lambda: (pick(other), f"{n(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"),
            lambda: (pick(other), f"{n(1, 28)}{(s := pick('./-'))}{n(1, 12)}{s}{n(1900, 2030)}"),
            lambda: (pick(other), f"{n(1900, 2000)}-{n(2001, 2030)}"),
            lambda: (pick(other), ".".join(n(0, 40) for _ in range(r.randint(2, 6)))),
            lambda: (pick(other), ".".join(n(100, 999) for _ in range(r.randint(2, 5)))),
            lambda: (pick(other), " ".join([n(1, 999), *(d(3) for _ in range(r.randint(1, 3)))])),
            lambda: (pick(other), f"{n(1, 99)}.{d(2)}{pick([' €', '%', ' kg', ' dollars', ''])}"),
            lambda: (pick(["$", "€", "£", "$ "]), pick([".", " "]).join([n(1, 999), *(d(3) for _ in range(r.randint(1, 2)))])),
            lambda: (pick(["ISBN ", "ISBN: ", ""]), f"97{pick('89')}-{n(0, 9)}-{d(4)}-{d(4)}-{d(1)}"),
            lambda: (pick(["ISSN ", "", "no. "]), f"{d(4)}-{d(4)}"),
            lambda: ("doi ", f"10.{d(4)}/{d(5)}"),
            lambda: (pick(other), f"{n(1, 99)}/{n(1, 99)}"),
            lambda: (pick(other), f"{n(10, 99)}-{n(10, 999)}-{n(10, 99)}"),
            lambda: (pick(other), f"{n(1, 99)} - {n(10, 99)}"),
            lambda: (pick(other), f"{n(10, 999)}-{n(10, 9999)}"),
            lambda: (pick(other), d(r.randint(7, 20))),
            lambda: (pick(other), "1" + d(9)),
            lambda: ("#", d(r.randint(7, 10))),
            lambda: (pick(other), self.card(valid=False)),
            lambda: (pick(other), " ".join(self.card(valid=False)[i : i + 4] for i in range(0, 16, 4))),
            lambda: (pick(other), up(r.randint(1, 3)) + pick(["", " ", "-"]) + d(r.randint(2, 6))),
            lambda: (pick(other), f"{up(2)}{d(2)}-{d(4)}{up(2)}"),
            lambda: (pick(other), up(2) + d(2) + pick([" ", ""]).join([d(4)] * r.randint(2, 4))),
            lambda: (pick(["at ", "", "from ", "until "]), f"{r.randint(0, 23):02d}:{d(2)}:{d(2)}"),
            lambda: (pick(["ratio ", "", "score "]), ":".join(n(1, 20) for _ in range(r.randint(3, 4)))),
            lambda: ("", pick(["std::vec", "a::b", "::", "1::2"])),
        )

    def word(self) -> str:
        c = self.r.choice
        return "".join(c("bcdfghjklmnprstvwz") + c("aeiou") + c(("", "", "n", "r", "s", "t")) for _ in range(self.r.randint(1, 3)))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(least, most)))

    def card(self, valid: bool = True) -> str:
        body = self.r.choice("3456") + "".join(self.r.choice("0123456789") for _ in range(14))
        total = sum(x if i % 2 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(map(int, reversed(body))))
        return body + str((-total + (0 if valid else self.r.randint(1, 9))) % 10)

    def iban(self, sep: str) -> str:
        country, length = self.r.choice((("DE", 18), ("ES", 20), ("GB", 18), ("FR", 23), ("NL", 14), ("BE", 12)))
        body = "".join(self.r.choice("0123456789") for _ in range(length))
        body = "".join(self.r.choice("ABCDEFGHIJ") for _ in range(4)) + body[4:] if country in ("GB", "NL") else body
        value = int("".join(str(int(c, 36)) for c in body + country + "00"))
        whole = f"{country}{98 - value % 97:02d}{body}"
        return sep.join(whole[i : i + 4] for i in range(0, len(whole), 4))


def findings(n: int, seed: int, without: tuple[str, ...] = ()) -> list[tuple[str, int, int, str, str]]:
    """n labelled findings (text, start, end, kind, family; both empty for a look-alike), half of each, made by rule."""
    m = Maker(seed)
    names, out = [f for f in m.families if f not in without], []
    for i in range(n):
        family = names[i // 2 % len(names)] if i % 2 else ""
        kind, lead, body = m.families[family]() if family else ("", *m.r.choice(m.plain)())
        before = m.words(0, 6) + m.r.choice([" ", ", ", ": ", "\n", " ("]) + lead
        text = before + body + m.r.choice(["", *(mark + m.words(0, 5) for mark in (" ", ". ", ", ", ") ", "\n", "! "))])
        out.append((text, len(before), len(before) + len(body), kind, family))
    return out


def labelled(spark: SparkSession, sets: list[list[tuple[str, int, int, str, str]]]) -> list[list[dict]]:
    """Of each set of findings, their candidates as rows of FEATURES, family, secret (whether it covers most of a finding and goes little beyond) and n: equal ones are counted together."""
    import json

    rows = json.dumps([{"part": k, "text": t, "a": a, "b": b, "family": family} for k, found in enumerate(sets) for t, a, b, _, family in found])
    table = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<part:int,text:string,a:bigint,b:bigint,family:string>>")).alias("x")).select("x.*")
    each = table.select("part", "a", "b", "family", F.explode(candidates(F.col("text"))).alias("c"))
    shared = F.least("b", "c.end") - F.greatest("a", "c.start")
    secret = (F.col("family") != "") & (10 * shared >= 8 * (F.col("b") - F.col("a"))) & (10 * shared >= 8 * (F.col("c.end") - F.col("c.start")))
    counted = each.select("part", "c.f.*", secret.cast("int").alias("secret"), F.when(secret, F.col("family")).otherwise("").alias("family"))
    out: list[list[dict]] = [[] for _ in sets]
    for r in counted.groupBy("part", *FEATURES, "secret", "family").agg(F.count("*").alias("n")).collect():
        out[r["part"]].append({k: v for k, v in r.asDict().items() if k != "part"})
    return out


def _table(rows: list[dict]):
    import numpy as np

    rows = sorted(rows, key=lambda r: tuple(map(str, r.values())))
    return np.array([[r[f] for f in FEATURES] for r in rows], dtype=np.int64).reshape(-1, len(FEATURES)), np.array([r["secret"] for r in rows], dtype=float), np.array([r["n"] for r in rows], dtype=float)


def boosted(x, y, n, *, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> list:
    """Trees by Newton steps on the logistic loss; a split is the cut of a feature that gains most."""
    import numpy as np

    cuts = [np.unique(x[:, k])[:-1] for k in range(x.shape[1])]
    below = {(k, c): x[:, k] <= c for k, some in enumerate(cuts) for c in some[:64].tolist()}
    splits, masks = list(below), np.array(list(below.values()), dtype=float)
    score, trees = np.zeros(len(y)), []

    def grow(inside, g, h, left):
        total_g, total_h = g[inside].sum(), h[inside].sum()
        worth = lambda a, b: a * a / (b + 1.0)
        if left and len(splits):
            lg, lh = masks @ (g * inside), masks @ (h * inside)
            gain = worth(lg, lh) + worth(total_g - lg, total_h - lh) - worth(total_g, total_h)
            gain[(lh < 1) | (total_h - lh < 1)] = 0
            best = int(gain.argmax())
            if gain[best] > 1e-3:
                k, c = splits[best]
                low = inside & below[k, c]
                return (FEATURES[k], c, grow(low, g, h, left - 1), grow(inside & ~low, g, h, left - 1))
        return round(float(-rate * total_g / (total_h + 1.0)), 6)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.ones(len(y), dtype=bool), n * (p - y), np.maximum(n * p * (1 - p), 1e-9), depth))
        score += values(trees[-1], x)
    return trees


def values(tree, x):
    """A tree's values of the rows of a table of features."""
    import numpy as np

    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    feature, cut, low, high = tree
    return np.where(x[:, FEATURES.index(feature)] <= cut, values(low, x), values(high, x))


def platt(z, y, n) -> tuple[float, float]:
    """Slope and shift that make scores probabilities: Newton's steps on Platt's targets."""
    import numpy as np

    pos, a, b = (n * y).sum(), 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (n.sum() - pos + 2))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w, e = n * q * (1 - q), n * (q - target)
        hessian = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(hessian, [(e * z).sum(), e.sum()])
    return float(a), float(b)


def train(spark: SparkSession, *, seed: int = SEED, n: int = EXAMPLES, recall: float = RECALL, without: tuple[str, ...] = ()) -> Trees:
    """Trees from n findings, calibrated on n / 2 others; thresholds from n / 2 more."""
    import numpy as np

    fitted, calibrating, held = labelled(spark, [findings(n, seed, without), findings(n // 2, seed + 1, without), findings(n // 2, seed + 2, without)])
    trees = boosted(*_table(fitted))
    scores = lambda x: sum(values(t, x) for t in trees)
    x, y, counts = _table(calibrating)
    a, b = platt(scores(x), y, counts)
    held = [r for r in held if r["secret"]]
    chances = 1 / (1 + np.exp(-np.clip(a * scores(_table_in_order(held)) + b, -40, 40)))
    thresholds: dict[str, float] = {}
    for kind, _ in GENERATORS:
        for family in {r["family"] for r in held if r["kind"] == KINDS.index(kind)}:
            own = np.sort(np.concatenate([[c] * r["n"] for c, r in zip(chances, held, strict=True) if r["family"] == family and r["kind"] == KINDS.index(kind)]))
            # A finding is at least as likely one as not: a family that the trees can't tell apart loses recall rather than clean text.
            least = max(0.5, float(own[int((1 - recall) * len(own))]))
            thresholds[kind] = min(thresholds.get(kind, 1.0), least)
    return Trees(tuple(trees), (a, b), thresholds)


def _table_in_order(rows: list[dict]):
    import numpy as np

    return np.array([[r[f] for f in FEATURES] for r in rows], dtype=np.int64).reshape(-1, len(FEATURES))


@lru_cache(2)
def _trained(seed: int) -> Trees:
    return train(SparkSession.active(), seed=seed)


def _added(base: Column, kept: Column) -> Column:
    """Candidates at their threshold that neither begin inside a base finding nor lie inside a span that is kept."""
    # A base finding has rank 0 and so stands before an equal candidate; of equal candidates the first kind's.
    marked = lambda spans, rank, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(rank).alias("rank"), kind(s).alias("kind")))
    in_order = lambda k: F.sort_array(F.concat(marked(base, 0, lambda s: s["kind"]), marked(k, 1, lambda s: s["f"]["kind"])))
    reach = lambda spans, least: running(F.transform(spans, lambda s: F.when(s["rank"] <= least, -s["back"]).otherwise(0)), 0, lambda a, x: F.greatest(a, x))
    before = lambda far, i: F.coalesce(F.get(far, i - 1), F.lit(0))
    outside = lambda spans, base_far, far: F.filter(spans, lambda s, i: (s["rank"] == 1) & (s["start"] >= before(base_far, i)) & (-s["back"] > before(far, i)))
    chosen = lambda k: let(in_order(k), lambda spans: let(reach(spans, 0), lambda base_far: let(reach(spans, 1), lambda far: outside(spans, base_far, far))))
    shaped = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("end")))
    return F.when(F.size(kept) > 0, shaped(chosen(kept))).otherwise(F.array().cast(_SPAN))


def with_spans(df: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """df with __base and __added: arrays of (kind, start, end) of its texts' findings. Its own columns must not be called so."""
    whole = F.coalesce(F.col(text), F.lit(""))
    proposed = df.select("*", F.concat(*[base_findings(whole, *b) for b in BASE]).alias("__base"), candidates(whole).alias("__proposed"))
    kept = proposed.select("*", F.expr(trees.kept_sql("__proposed")).alias("__kept")).drop("__proposed")
    return kept.select("*", _added(F.col("__base"), F.col("__kept")).alias("__added")).drop("__kept")


def _joined(spans: Column) -> Column:
    name = lambda kind: F.get(F.array(*[F.lit(k) for k in KINDS]), kind)
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    trees = trees or _trained(SEED)
    found = with_spans(docs.select("doc_id", "text"), trees)
    of_kind = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{KINDS[k]}") for k in range(len(BASE))]
    digest = F.sha2(_joined(F.col("__base")), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), _joined(F.concat("__base", "__added")).alias("spans"), F.size("__added").cast("long").alias("n_added"))


def redact(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """docs with each span of their texts, overlapping ones united, replaced by its first kind in angle brackets; a null text stays null."""
    found = with_spans(rows_with(docs, text=F.col("text")), trees or _trained(SEED))
    by_place = F.sort_array(F.transform(F.concat("__base", "__added"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    reach = lambda p: running(F.transform(p, lambda x: x["end"]), 0, lambda a, x: F.greatest(a, x))
    name = lambda kind: F.get(F.array(*[F.lit(f"<{k}>") for k in KINDS]), kind)
    # What stands before a span: from the furthest end so far, nothing if the span begins before it. A span that begins so adds no mark.
    piece = lambda p, far: F.transform(
        p,
        lambda x, i: let(
            F.coalesce(F.get(far, i - 1), F.lit(0)),
            lambda e: F.when((x["start"] < e) & (i > 0), F.lit("")).otherwise(F.concat(F.substring(F.col("text"), (e + 1).cast("int"), (x["start"] - e).cast("int")), name(x["kind"]))),
        ),
    )
    rest = lambda far: F.substring(F.col("text"), (F.get(far, F.size(far) - 1) + 1).cast("int"), F.length(F.col("text")))
    shown = lambda p: F.when(F.size(p) == 0, F.col("text")).otherwise(let(reach(p), lambda far: F.concat(F.array_join(piece(p, far), ""), rest(far))))
    redacted = found.select("row", F.when(F.col("text").isNotNull(), let(by_place, shown)).alias("text"))
    return redacted.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


QUERIES = {"op11_pii": op11_pii}
#: The base kinds are checked by Python's patterns, the trees by an own evaluation: tests/llm/test_pii.py.
ORACLES: dict[str, str] = {}
