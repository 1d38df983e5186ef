"""Variant spellings of names typed by people, linked by merge-and-rematch resolution.

A surface text is read as a profile: what it names (a person, an organisation, a component), the
spelling of its proper part (surname, house), and what tells things of one proper name apart: the
given name, the business words, the designation. Initials are weak evidence of the latter.

Which words are common ones is learned from the column (:func:`learn`): a common word is seldom the
rarest word of the texts that hold it; it is a business word where these texts end in a legal form,
a word for a kind of thing where they hold a designation, else a given name. Short forms of given
names are learned from rows whose two texts differ in that word only. General lists and a table of
short names, both parameters of :class:`Vocabulary`, serve where a column is too small to learn from.

Two spellings are near if one edit lies between them, letters typed several times in a row counted
once, or in long ones if one letter has moved; spellings of under ``LEAST_NEAR`` letters must be equal, and two spellings that are each borne
with ``ESTABLISHED`` or more different keys are two names, not a name and a typo. Candidates share a
hash of their deletion neighbourhoods, and each candidate pair of spellings is then compared.

Records of one key and near spellings merge; the merged record has the spellings, keys and initials
of all its members and enters blocking again, until nothing merges any more. A record with initials
only joins the full record that they fit; where they fit records of different keys, it joins none,
so records of different full given names, business words or designations never merge.

A cell of spelling and key is reduced to its smallest record before any pairing, so hot names are
never paired off within a group. What a round shuffles is one row per record and spelling; only the
spellings that differ by one edit are ever paired, and those are found once. From the second round
on only records that merged in the round before look for others.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.groups import connected_components
from kgloom.session import cut, drop

# Fixed values of general use: common words of organisations' names, legal forms, kinds of
# components, titles, and given names with those of their short forms that no rule gives.
BUSINESS = tuple(
    """aerospace agency airlines airways analytics architects associates automotive aviation avionics bakery bank bearings biotech brewery
    broadcasting brothers cable capital castings ceramics chemicals communications composites computing consulting controls dairy defence
    devices distribution dynamics electric electronics energy engineering enterprises equipment fabrication finance foods forge foundation
    foundry freight furniture gas glass group hardware healthcare holdings hospital hydraulics imaging industries innovations institute
    instruments insurance international laboratories lighting logistics machinery manufacturing marine materials media metals microsystems
    mining motors navigation networks oil optics orbital packaging paper partners petroleum pharmaceuticals photonics plastics power
    precision press printing products propulsion publishing pumps railways research resources robotics rubber satellites security
    semiconductors sensors services shipping software solutions space steel structures supplies systems technologies telecom textiles tools
    toys trading transport trust turbines university utilities ventures water wireless works""".split()
)
LEGAL = tuple("ab ag as aps bv co company corp corporation gmbh inc incorporated kg kk limited llc llp ltd nv oy oyj plc pty pte sa sarl sas se spa srl".split())
KINDS = tuple(
    """actuator adapter amplifier antenna array assembly band battery board by camera cell cold computer connector control controller
    converter coupler cylinder detector digital distribution drive driver electronics encoder engine fan filter gas gauge generator gimbal
    gyroscope harness head heater inverter kit laser lens link lock magnetic main mechanism meter mirror module motor mount nozzle onboard
    optical pack panel patch pressure processor propellant pump radiator reaction receiver recorder regulator relay rod seal sensor servo
    solar star sun supply switch system tank terminal thermal thruster torque tracker transceiver transducer transmitter tube unit valve
    wheel wing""".split()
)
TITLES = ("dr", "prof", "mr", "mrs", "ms", "miss", "sir", "ing", "dipl", "phd", "jr", "sr", "eng")
NICKNAMES: dict[str, tuple[str, ...]] = {
    "albert": ("bert",), "alexander": ("sasha", "xander", "lex", "sandy"), "alexandra": ("sasha", "sandy"), "andrew": ("drew",), "anthony": ("tony",),
    "barbara": ("babs",), "benjamin": (), "catherine": ("kate", "katie", "kit", "kitty", "kay"), "charles": ("chuck",), "christopher": ("kit", "topher", "kris"),
    "daniel": (), "david": ("dave",), "deborah": ("debbie",), "dorothea": ("dora", "thea", "dot", "dolly"), "dorothy": ("dora", "dot", "dolly"), "edward": ("ed", "eddie", "ted", "ned"),
    "elizabeth": ("liz", "lizzie", "beth", "betty", "betsy", "libby", "lisa", "elsie", "bess"), "florence": ("flo",), "frances": ("fanny",), "francis": ("frank",),
    "frederick": ("rick", "fritz"), "gabriella": ("ella", "bella", "brie"), "gregory": (), "harold": ("hal", "harry"), "helen": ("nell",),
    "henrietta": ("etta", "hetty", "hattie", "ettie"), "henry": ("hank", "harry", "hal"), "isabella": ("izzy", "bella", "belle"), "jacob": ("jake",),
    "james": ("jim", "jimmy", "jamie"), "jennifer": ("jenny",), "john": ("jack", "johnny"), "jonathan": ("jon", "john", "johnny", "nathan"), "joseph": ("joe", "joey"), "joshua": (),
    "katherine": ("kate", "katie", "kit", "kitty", "kay"), "lawrence": ("larry",), "leonard": ("len", "lenny", "lee"), "margaret": ("meg", "peggy", "marge", "greta", "madge", "rita"),
    "martha": ("patty",), "matthew": (), "michael": ("mike", "mick", "mickey"), "nathaniel": ("nate",), "nicholas": ("nick", "nicky", "nico", "klaus", "claus"), "patricia": ("trish", "tricia", "patsy"),
    "patrick": ("paddy",), "peter": (), "philip": ("pip",), "rebecca": ("becky",), "richard": ("dick", "rick"), "robert": ("bob", "bobby", "bert", "robin"),
    "ronald": (), "samantha": ("mandy",), "samuel": (), "sarah": ("sally",), "stephen": ("steve",), "steven": (), "susan": ("sue",), "theodore": ("ted", "dore"),
    "thomas": ("tom", "tommy"), "timothy": (), "veronica": ("vera", "ronnie", "nica", "vee"), "victoria": ("vicky",), "virginia": ("ginny",), "walter": (), "william": ("bill", "billy", "liam"), "zachary": ("zack",),
}

#: Shorter spellings must be equal.
LEAST_NEAR = 6
#: In spellings of so many letters, one letter may also stand in another place.
LEAST_MOVED = 9
#: A spelling borne with so many different keys is a name of its own, no typo of another such one.
ESTABLISHED = 4
#: A word is learned from at least so many texts, and from at least one text in ``SHARE``; as every
#: text has few words, that bounds what is learned (and sent to all executors) at any size.
LEAST_TEXTS, SHARE = 10, 5_000
#: A short form is learned from at least so many rows, and one row in ``ROW_SHARE``.
LEAST_ROWS, ROW_SHARE = 5, 50_000


def deletions(word: str) -> set[str]:
    """The word and all words with one character less."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def once(spelling: str) -> str:
    """Every letter typed several times in a row once."""
    return re.sub(r"([^\W\d])\1+", r"\1", spelling)


def near(a: str, b: str) -> bool:
    """Whether two spellings may be one name, by their letters alone."""
    if a == b:
        return True
    least = min(len(a), len(b))
    if least < LEAST_NEAR:
        return False
    return any(one_edit(x, y) or (least >= LEAST_MOVED and not deletions(x).isdisjoint(deletions(y))) for x in {a, once(a)} for y in {b, once(b)})


def abbreviates(short: str, word: str) -> int:
    """2 if the word begins with the short form, 1 if it has its letters in order, first letter first; else 0."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return 0
    if word.startswith(short) or (len(short) > 3 and short[-1] == "s" and word.startswith(short[:-1])):
        return 2
    letters = iter(word)
    return int(len(short) <= 5 and all(c in letters for c in short))


def _stem(short: str) -> str:
    """A short given name without its diminutive ending: freddy, jonnie -> fred, jon."""
    s = re.sub(r"(?:ie|ey|y|i)$", "", short) if len(short) > 3 else short
    return s[:-1] if len(s) > 2 and s[-1] == s[-2] else s


@dataclass
class Vocabulary:
    """Common words: given ones in general, and what :func:`learn` found in the column (with counts)."""

    business: tuple[str, ...] = BUSINESS
    kinds: tuple[str, ...] = KINDS
    legal: tuple[str, ...] = LEGAL
    titles: tuple[str, ...] = TITLES
    nicknames: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: NICKNAMES)
    learned_business: Mapping[str, int] = field(default_factory=dict)
    learned_kinds: Mapping[str, int] = field(default_factory=dict)
    learned_givens: Mapping[str, int] = field(default_factory=dict)
    learned_short: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


class Reader:
    """Reads surface texts as profiles by one vocabulary."""

    def __init__(self, vocabulary: Vocabulary | None = None):
        v = self.v = vocabulary or Vocabulary()
        learned = {*v.learned_business, *v.learned_kinds, *v.learned_givens}
        self.business = {*v.learned_business, *(w for w in v.business if w not in learned)}
        self.kinds = {*v.learned_kinds, *(w for w in v.kinds if w not in learned)}
        self.full = {*v.nicknames, *v.learned_givens}
        self.legal, self.titles = set(v.legal), set(v.titles)
        self.irregular: dict[str, set[str]] = {}
        for name, shorts in v.nicknames.items():
            for s in shorts:
                self.irregular.setdefault(s, set()).add(name)
        self.ends: dict[str, set[str]] = {}
        for n in self.full:
            if n not in self.irregular and n not in v.learned_short:
                for part in {n[:k] for k in range(3, len(n))} | ({n[k:] for k in range(1, len(n) - 3)} if n in v.learned_givens else set()):
                    self.ends.setdefault(part, set()).add(n)
        self.common_first = self._by_letter(v.learned_business), self._by_letter(self.business)
        self.kind_first = self._by_letter(self.kinds)
        self.near_business = self._near_tables(self.business, v.learned_business)
        self.near_kinds = self._near_tables(self.kinds, v.learned_kinds)
        self.near_givens = self._near_tables({n for n in self.full if n not in v.learned_short}, v.learned_givens)
        self.longest = 1 + max(map(len, (*self.business, *self.kinds, *self.full, "")))
        self._known: dict[tuple[str, str], tuple[str, ...]] = {}

    @staticmethod
    def _by_letter(words) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for w in sorted(words):
            out.setdefault(w[0], []).append(w)
        return out

    @staticmethod
    def _near_tables(words: set[str], learned: Mapping[str, int]) -> list[dict[str, set[str]]]:
        """Deletions of the words of five letters or more: those of the column first."""
        tables: list[dict[str, set[str]]] = [{}, {}]
        for w in words:
            if len(w) >= 5:
                for v in deletions(w):
                    tables[w not in learned].setdefault(v, set()).add(w)
        return tables

    def _near(self, word: str, tables: list[dict[str, set[str]]]) -> str | None:
        if len(word) > self.longest:
            return None
        for table in tables:
            found = {w for v in deletions(word) for w in table.get(v, ()) if one_edit(word, w)}
            if found:
                return min(found)
        return None

    def _memo(self, what: str, find, token: str) -> tuple[str, ...]:
        at = what, token.lower()
        if at not in self._known:
            if len(self._known) > 400_000:
                self._known.clear()
            self._known[at] = find(at[1])
        return self._known[at]

    def business_words(self, token: str) -> tuple[str, ...]:
        """The business words that a token may mean: none, one, or several for an unclear short form."""
        return self._memo("business", self._find_business, token)

    def says_business(self, token: str) -> bool:
        """Whether the token alone shows that an organisation is named."""
        t, words = token.lower(), self.business_words(token)
        return bool(words) and (t in self.business or (not self.givens(t) and (len(t) > 3 or any(w.startswith(t) for w in words))))

    def kind_word(self, token: str) -> bool:
        return bool(self._memo("kind", self._find_kind, token))

    def givens(self, token: str) -> tuple[str, ...]:
        """The full given names that a token may mean."""
        return self._memo("given", self._find_givens, token)

    def _find_business(self, t: str) -> tuple[str, ...]:
        if len(t) < 2 or t in self.v.learned_short or (t in self.full and t not in self.business):
            return ()
        often = self.v.learned_business
        if len(t) >= 3 or t in self.business:
            for words in self.common_first:
                # A word that is itself common is a short form only of a much more common one.
                longer = {w: abbreviates(t, w) for w in words.get(t[0], ()) if t not in self.business or often.get(w, 0) >= 4 * max(often.get(t, 0), 1)}
                for grade in (2, 1):
                    found = [w for w, g in longer.items() if g == grade]
                    # Of words that are short for each other (tech, technol, technologies) the longest.
                    found = [w for w in found if not any(o != w and o.startswith(w) for o in found)]
                    if found and (len(found) == 1 or t not in self.business):
                        return tuple(found)
        if t in self.business:
            return (t,)
        if len(t) < 4 or t in self.irregular:
            return ()
        got = self._near(t, self.near_business)
        return (got,) if got else ()

    def _find_kind(self, t: str) -> tuple[str, ...]:
        if t in self.kinds or (len(t) <= 5 and any(abbreviates(t, w) for w in self.kind_first.get(t[0], ()))):
            return (t,)
        got = self._near(t, self.near_kinds) if len(t) >= 4 else None
        return (got,) if got else ()

    def _find_givens(self, t: str) -> tuple[str, ...]:
        if t in self.v.learned_short:
            return self.v.learned_short[t]
        often = self.v.learned_givens
        if t in self.v.nicknames and t not in self.irregular:
            return (t,)
        if len(t) >= 2:
            # A common name is a short form only of a much more common one; of several full names
            # those count that the column has.
            stem = _stem(t)
            found = {*self.irregular.get(t, ()), *self.ends.get(stem, ()), *(self.ends.get(t, ()) if len(t) > 3 else ())}
            found = {n for n in found if n != t and often.get(n, 0) >= 4 * often.get(t, 0)}
            here = {n for n in found if n in often}
            if found:
                return tuple(sorted(here or found))
        if t in self.full:
            return (t,)
        got = self._near(t, self.near_givens) if len(t) >= 5 and t not in self.business else None
        return (got,) if got else ()

    def read(self, text: str) -> Profile | None:
        """The profile of a surface text; null where nothing is left of it.

        ``strong`` tells things of one proper name apart; a profile without it has weak keys only.
        ``bag`` are the words in order of the alphabet where nothing says what they are: such texts
        are one name if their words are the same.
        """
        text = _clean(text)
        m = list(_DESIGNATION.finditer(text))
        if m:
            return self._component(text, m[-1])
        if re.search(r"\d", text):
            words = re.findall(r"\w+", text.lower())
            return Profile("other", " ".join(sorted(words)), "", [])
        # Dotted legal forms follow at least two words; behind a surname they are initials.
        dotted = re.search(r"(?:(?<=\s)|(?<=,))((?:[^\W\d_]\.){2,5})\s*$", text)
        if dotted and dotted[1].replace(".", "").lower() in self.legal and sum(len(w) > 1 for w in re.findall(r"\w+", text[: dotted.start()])) > 1:
            text = text[: dotted.start()] + dotted[1].replace(".", "")
        split = re.sub(r"(?<=[a-z])(?=[A-Z][a-z]{2})", " ", text)
        tokens = re.findall(r"[^\W\d_]+", split)
        if not tokens:
            rest = re.sub(r"\s+", "", text.lower())
            return Profile("other", rest, "", []) if rest else None
        return self._organisation(tokens) or self._person(text, tokens)

    def _component(self, text: str, m: re.Match) -> Profile:
        code = f"{m[1].lower()}{m[2]}"
        rest = re.findall(r"[^\W\d_]+", text[: m.start()] + " " + text[m.end() :])
        houses = [t for t in rest if not self.kind_word(t) and not (len(t) <= 4 and (t.isupper() or t.lower() == m[1].lower()))]
        houses = houses or [t for t in rest if len(t) > 4 and t.lower() not in self.kinds]
        return Profile("component", max(houses, key=len).lower() if houses else "", code, [])

    def _organisation(self, tokens: list[str]) -> Profile | None:
        words = list(tokens)
        legal = False
        while len(words) > 1 and words[-1].lower() in self.legal and (len(words) > 2 or not (words[-1].isupper() or self.givens(words[0]))):
            words.pop()
            legal = True
        # Capitals behind a house not in capitals are initials of its business words.
        if len(words) == 2 and words[1].isupper() and 2 <= len(words[1]) <= 5 and len(words[0]) > 5 and not words[0].isupper() and not self.givens(words[0]):
            return Profile("organisation", words[0].lower(), None, [words[1].lower()])
        meant = [self.business_words(w) if len(w) > 1 else () for w in words]
        if not legal and not any(self.says_business(w) for w in words):
            return None
        # Legal forms before the end ("Ltd, ...") are no part of the name.
        kept = [(w, k) for w, k in zip(words, meant) if w.lower() not in self.legal or k] or list(zip(words, meant))
        houses = [w for w, k in kept if not k] or [kept[0][0]]
        house = max(houses, key=lambda w: (len(w), w.lower()))
        rest = [(w, k) for w, k in kept if w is not house]
        initials = "".join(k[0][0] if k else w[0].lower() for w, k in rest)
        if any(len(k) > 1 for _, k in rest):
            return Profile("organisation", house.lower(), None, [initials])
        return Profile("organisation", house.lower(), " ".join(sorted(k[0] if k else w.lower() for w, k in rest)), [initials])

    def _person(self, text: str, tokens: list[str]) -> Profile:
        tokens = [t for t in tokens if t.lower() not in self.titles] or tokens
        letters = [t.lower() for t in tokens if len(t) == 1]
        names = [t for t in tokens if len(t) > 1]
        if not names:
            return Profile("person", "".join(letters), "", [])
        given: tuple[str, ...] = ()
        rest, known = list(names), False
        for t in sorted(names, key=lambda t: (t.lower() not in self.full and t.lower() not in self.irregular and t.lower() not in self.v.learned_short, -len(t))):
            if len(rest) > 1 and self.givens(t):
                given, known = self.givens(t), True
                rest.remove(t)
                break
        if not given and len(rest) > 1:
            first = rest[-1] if "," in text else rest[0]
            rest.remove(first)
            if len(first) <= 3 and first.isupper():  # initials without dots
                letters = [*first.lower(), *letters]
            else:
                given = (first.lower(),)
        surname = " ".join(t.lower() for t in rest)
        bag = " ".join(sorted(t.lower() for t in names)) if given and not known else None
        if len(given) == 1:
            return Profile("person", surname, given[0], [given[0], given[0][0]], bag)
        if given:
            return Profile("person", surname, None, list(given))
        if letters:
            return Profile("person", surname, None, [letters[0]])
        return Profile("person", surname, "", [])


@dataclass(frozen=True)
class Profile:
    kind: str
    spelling: str
    strong: str | None
    weak: list[str]
    bag: str | None = None


_DESIGNATION = re.compile(r"([^\W\d_]{1,5})[\s_/.\-]?\s?(\d+)(?![^\W_])")


def _clean(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    return "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c.isspace())


def parse(text: str, vocabulary: Vocabulary | None = None) -> tuple[str, str, str | None, list[str]] | None:
    """(kind, spelling, strong key, weak keys) of one surface text."""
    p = Reader(vocabulary).read(text)
    return p and (p.kind, p.spelling, p.strong, p.weak)


_PRIME, _BASE = (1 << 61) - 1, 0x5851F42D4C957F2D % ((1 << 61) - 1)


def neighbourhood(spelling: str) -> list[int]:
    """Hashes of the spelling and of all its deletions of one character, in time linear in its length."""
    n = len(spelling)
    prefix, power = [0], [1]
    for c in spelling:
        prefix.append((prefix[-1] * _BASE + ord(c)) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    whole = prefix[n]
    # Without character i: what is before it, moved up, and what is behind it.
    return sorted({whole} | {(prefix[i] * power[n - 1 - i] + whole - prefix[i + 1] * power[n - 1 - i]) % _PRIME for i in range(n)})


def _variant_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(variants=[sorted({*neighbourhood(s), *(neighbourhood(o) if (o := once(s)) != s else ())}) for s in b["spelling"]])


def _near_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[[near(x, y) for x, y in zip(b["x"], b["y"])]]


_TOKENS = r"[\p{L}]{2,}"


def learn(texts: DataFrame, pairs: DataFrame | None = None, base: Vocabulary | None = None) -> Vocabulary:
    """The vocabulary of a column of different texts (``surface``), from the words' company in it.

    ``pairs`` (``surface_a``, ``surface_b``) are rows that name two texts; of two that differ in one
    word only, the rarer word is learned as a short form of the other if a quarter of its rows say
    so. What is collected is words in at least one text of ``SHARE`` and pairs of words in at least
    one row of ``ROW_SHARE``, hence a bounded number at any size.
    """
    base = base or Vocabulary()
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("surface"), F.lit(_TOKENS), F.lit(0)))).alias("w"))
    n_texts = texts.count()
    floor = max(LEAST_TEXTS, -(-n_texts // SHARE))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    named = sorted(base.nicknames)
    seen = {r["w"]: r["n"] for r in counts.where((F.col("n") >= floor) | F.col("w").isin(named)).collect()}
    skip = {*base.legal, *base.titles}
    often = {w: n for w, n in seen.items() if n >= floor and w not in skip}
    legal = set(base.legal)

    def company(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = re.compile(r"[^\W\d_]{2,}")
        for b in batches:
            tally: dict[str, list[int]] = {}
            for text in b["surface"]:
                low = text.lower()
                ws = dict.fromkeys(pattern.findall(low))
                code = _DESIGNATION.search(text) is not None
                ends = bool(ws) and (next(reversed(ws)) in legal or re.sub(r"\W+", "", low.rpartition(" ")[2]) in legal)
                # The rarest word is the proper name, unless all are common.
                rare = min(ws, key=lambda w: (often.get(w, 0), -len(w))) if ws else None
                for w in ws:
                    if w in often:
                        t = tally.setdefault(w, [0, 0, 0, 0])
                        t[0] += 1
                        t[1] += w == rare
                        t[2] += code
                        t[3] += ends
            yield pd.DataFrame([(w, *t) for w, t in tally.items()], columns=["w", "n", "rare", "code", "legal"])

    found = texts.select("surface").mapInPandas(company, "w string, n bigint, rare bigint, code bigint, legal bigint")
    stats = {r["w"]: r for r in found.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("n", "rare", "code", "legal")]).collect()} if often else {}
    business, kinds, givens = {}, {}, {w: seen[w] for w in named if w in seen}
    for w, r in sorted(stats.items(), key=lambda x: (-x[1]["n"], x[0])):
        if 2 * r["rare"] > r["n"]:
            continue
        into = kinds if 2 * r["code"] > r["n"] else business if 5 * r["legal"] >= r["n"] else givens
        # A word one edit from a much more common one is a typo of it.
        if not (len(w) >= 5 and any(c[0] == w[0] and one_edit(w, c) and n >= 10 * r["n"] for known in (business, kinds, givens) for c, n in known.items())):
            into[w] = r["n"]
    short = {} if pairs is None or not givens else _short_forms(pairs, givens)
    return Vocabulary(base.business, base.kinds, base.legal, base.titles, base.nicknames, business, kinds, givens, short)


def _short_forms(pairs: DataFrame, givens: Mapping[str, int]) -> dict[str, tuple[str, ...]]:
    """short form -> full names, from rows whose texts are two words of which one differs."""

    def two(c: str) -> Column:
        return F.split(F.lower(F.col(c)), r"[ ,]+")

    rows = pairs.select(two("surface_a").alias("a"), two("surface_b").alias("b")).where((F.size("a") == 2) & (F.size("b") == 2)).distinct()
    only_a, only_b = F.array_except("a", "b"), F.array_except("b", "a")
    differ = rows.select(only_a.alias("a"), only_b.alias("b")).where((F.size("a") == 1) & (F.size("b") == 1)).select(F.explode(F.array(F.struct(F.col("a")[0].alias("s"), F.col("b")[0].alias("f")), F.struct(F.col("b")[0].alias("s"), F.col("a")[0].alias("f")))).alias("x")).select("x.*")
    plain = F.col("s").rlike(r"^\p{L}{2,}\z") & F.col("f").rlike(r"^\p{L}{2,}\z")
    counted = differ.where(plain).groupBy("s", "f").agg(F.count(F.lit(1)).alias("n"))
    floor = max(LEAST_ROWS, -(-pairs.count() // ROW_SHARE))
    by_short: dict[str, Counter] = {}
    for r in counted.where(F.col("n") >= floor).collect():
        by_short.setdefault(r["s"], Counter())[r["f"]] = r["n"]
    out = {}
    for s, fulls in by_short.items():
        total = sum(fulls.values())
        got = tuple(sorted(f for f, n in fulls.items() if 4 * n >= total and givens.get(f, 0) >= 4 * max(1, givens.get(s, 0)) and not one_edit(s, f)))
        if got:
            out[s] = got
    return out


def resolve(surfaces: DataFrame, surface: str = "surface", vocabulary: Vocabulary | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """surface, name_id: every different non-null text with the id of the thing that it names.

    ``vocabulary`` replaces what :func:`learn` finds in the column (and in ``pairs``). A text of
    which nothing can be read (blank, or only marks) names only itself. The id is a number, unique
    within one result. Repeated rows and other columns do not matter.
    """
    texts = cut(surfaces.select(F.col(surface).alias("surface")).where(F.col("surface").isNotNull()).distinct())
    words = vocabulary or learn(texts, pairs)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(words)
        for batch in batches:
            got = [(s, p.kind, p.spelling, p.strong, p.weak, p.bag) for s in batch["surface"] if (p := reader.read(s)) is not None]
            yield pd.DataFrame(got, columns=["surface", "kind", "spelling", "strong", "weak", "bag"])

    parsed = texts.mapInPandas(read, "surface string, kind string, spelling string, strong string, weak array<string>, bag string")
    same = F.md5(F.concat_ws("\u0000", "kind", "spelling", F.coalesce(F.concat(F.lit("="), "strong"), F.concat(F.lit("?"), F.array_join("weak", " ")))))
    parsed = cut(parsed.withColumn("profile", same))
    drop(texts)
    first = [F.first(c).alias(c) for c in ("kind", "spelling", "strong")]
    different = parsed.groupBy("profile").agg(*first, F.array_distinct(F.flatten(F.collect_set("weak"))).alias("weak"))
    # Numbers given once and written; they are cheaper to compare and to shuffle than the hashes.
    profiles = cut(different.withColumn("id", F.monotonically_increasing_id()))
    neighbours = cut(_neighbours(profiles))
    bags = parsed.where(F.col("bag").isNotNull()).join(profiles.select("profile", "id"), "profile")
    least = bags.groupBy("bag").agg(F.min("id").alias("a"), F.max("id").alias("z")).where(F.col("a") != F.col("z"))
    extra: DataFrame | None = bags.join(least, "bag").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"))
    facts = profiles.select("id", "kind", "spelling", "strong", "weak")
    now = facts.withColumns({"record": F.col("id"), "moved": F.lit(True)})
    while True:
        links = cut(_links(now, neighbours) if extra is None else _links(now, neighbours).unionAll(extra))
        if links.isEmpty():
            break
        groups = connected_components(links)
        merged = groups.select(F.col("node").alias("record"), F.col("group").alias("__g"))
        after = cut(now.drop("moved").join(merged, "record", "left").select(*facts.columns, F.coalesce("__g", "record").alias("record"), F.col("__g").isNotNull().alias("moved")))
        drop(now, links, groups)
        now, extra = after, None
    named = profiles.select("profile", "id").join(now.select("id", "record"), "id")
    return parsed.select("surface", "profile").join(named, "profile").select("surface", F.col("record").alias("name_id"))


def _neighbours(profiles: DataFrame) -> DataFrame:
    """kind, x, y: spellings within one edit of each other, in both directions."""
    borne = profiles.groupBy("kind", "spelling").agg((F.count_distinct("strong") >= ESTABLISHED).alias("established"))
    spelled = borne.where((F.length("spelling") >= LEAST_NEAR) & (F.col("kind") != "other"))
    tried = spelled.mapInPandas(_variant_batches, "kind string, spelling string, established boolean, variants array<bigint>")
    one = cut(tried.select("kind", "spelling", "established", F.explode("variants").alias("v")))
    shared = one.groupBy("kind", "v").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where(F.col("lo") != F.col("hi")).select("kind", "v")
    few = cut(one.join(shared, ["kind", "v"], "left_semi"))
    x, y = few.select("kind", "v", F.col("spelling").alias("x"), F.col("established").alias("ex")), few.select("kind", "v", F.col("spelling").alias("y"), F.col("established").alias("ey"))
    pairs = x.join(y, ["kind", "v"]).where((F.col("x") < F.col("y")) & ~(F.col("ex") & F.col("ey"))).select("kind", "x", "y").distinct()
    return pairs.mapInPandas(_near_batches, "kind string, x string, y string").select("kind", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p")).select("kind", "p.*")


def _links(now: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Pairs of records (a, b) that merge: of one key and near spellings, or of initials that fit one record only."""
    keys = now.groupBy("record").agg(F.max("strong").alias("key"), F.max("moved").alias("moved"))
    cells = cut(now.select("record", "kind", "spelling").distinct().join(keys.where(F.col("key").isNotNull()), "record"))
    # One record stands for all of its cell; those of a cell are one, and so are those of near cells.
    least = cells.groupBy("kind", "spelling", "key").agg(F.min("record").alias("a"), F.max("record").alias("z"), F.max("moved").alias("moved"))
    inside = cells.join(least.where(F.col("a") != F.col("z")).select("kind", "spelling", "key", "a"), ["kind", "spelling", "key"]).where(F.col("record") != F.col("a")).select("a", F.col("record").alias("b"))
    least = cut(least)
    ask = least.where("moved").select("kind", F.col("spelling").alias("x"), "key", "a").join(neighbours, ["kind", "x"])
    beside = ask.join(least.select("kind", F.col("spelling").alias("y"), "key", F.col("a").alias("b")), ["kind", "y", "key"]).where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Records with initials only: the one full record that fits, first by the same spelling. Full
    # records of one key are one thing, bridged by the spelling between theirs.
    hints = now.where(F.col("strong").isNotNull()).select("record", F.explode("weak").alias("w")).distinct().join(cells.select("record", "kind", "spelling", "key"), "record")
    ends = [F.min("record").alias("lo"), F.max("record").alias("hi"), F.min("key").alias("s"), F.max("key").alias("t")]
    fits = hints.groupBy("kind", "spelling", "w").agg(*ends)
    lone = now.join(keys.where(F.col("key").isNull()).select("record"), "record", "left_semi").select("record", "kind", "spelling", F.explode("weak").alias("w")).distinct()
    near_ = lone.withColumnRenamed("spelling", "x").join(neighbours, ["kind", "x"]).select("record", "kind", F.col("y").alias("spelling"), "w", F.lit(False).alias("exact"))
    asked = lone.withColumn("exact", F.lit(True)).unionByName(near_).join(fits, ["kind", "spelling", "w"])
    asked = asked.groupBy("record", "exact").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("s").alias("s"), F.max("t").alias("t"))
    one = asked.groupBy("record").agg(F.max_by(F.struct("lo", "hi", "s", "t"), "exact").alias("x"))
    fit = one.where((F.col("x.lo") == F.col("x.hi")) | (F.col("x.s") == F.col("x.t")))
    initials = fit.select(F.explode(F.array("x.lo", "x.hi")).alias("a"), F.col("record").alias("b"))
    return inside.unionAll(beside).unionAll(initials).distinct()


def name_pairs(candidates: DataFrame) -> DataFrame:
    """surface_a, surface_b of the rows, as learned from."""
    return candidates.select("surface_a", "surface_b").where(F.col("surface_a").isNotNull() & F.col("surface_b").isNotNull())


def names(candidates: DataFrame) -> DataFrame:
    """surface, name_id of every different non-null text of either column, one row per text."""
    texts = candidates.select(F.explode(F.array("surface_a", "surface_b")).alias("surface"))
    return resolve(texts, pairs=name_pairs(candidates))


def variant_pairs(candidates: DataFrame) -> DataFrame:
    """surface_lo, surface_hi: all pairs of different texts of either column that name one thing.

    The pairs grow with the square of a thing's spellings; :func:`names` gives the same as membership.
    """
    named = cut(names(candidates))
    lo, hi = named.select("name_id", F.col("surface").alias("surface_lo")), named.select("name_id", F.col("surface").alias("surface_hi"))
    return lo.join(hi, "name_id").where(F.col("surface_lo") < F.col("surface_hi")).select("surface_lo", "surface_hi")
