"""Linking the spellings people use for one person or organisation (problem 4).

Names are read into all their tokens, of which the likeliest surname or proper word is the core. Every token goes through
a symmetric-delete neighbourhood index, which finds small edit distances without comparing all tokens; the tokens of two
names are then aligned one to one by the best assignment, where initials, abbreviations and nicknames may stand for full
tokens. Full names that align are linked and closed over by label propagation; names that say less (initials, a bare
core, a word left out) join a group only if exactly one fits.

Which token is a surname, a given name or a proper word follows from all rows: how often a token stands before and after
the others, and in names of persons and of organisations. The tables of given names and lines of business only add to it.

Scale: equal spellings collapse to one form before anything is compared, so a name held by a third of all rows costs one
form; forms are compared only where a token is near and another begins alike. Labels travel in checkpointed rounds, nothing is
collected.

Defined results
    * names of nobody in particular, null and empty names and names without a word of two letters are in no pair; tokens
      of fewer than four letters are compared as equal or not.
    * a record may have several names (file versions, aliases); each counts, and rows delivered twice count once.
    * a name that fits two different groups equally well joins neither.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.spelling import abbreviates, allowed, assign, deletes, distance, near_keys, plain, uncamel
from weftline.plans.runtime import cut

# Common given names and the short forms in use for them (a parameter of the reader).
NICKNAMES = """
abigail: abby gail | alexander: alex sasha sandy lex | andrew: andy drew | anthony: tony ant | benjamin: ben benny
charles: charlie chuck | christopher: chris kit | cordelia: delia cordy | cynthia: cindy | daniel: dan danny
deborah: deb debbie | dmitri: dima mitya | dorothy: dot dottie dolly | edward: ed eddie ted ned | ekaterina: katya kate
elizabeth: liz lizzie beth betty eliza | emmanuel: manny | frances: fran frankie | francisco: paco pancho fran
frederick: fred freddie | gabriela: gabi gaby | gregory: greg | guadalupe: lupe | harriet: hattie harry | ignacio: nacho
isabella: bella izzy | jacqueline: jackie | james: jim jimmy jamie | jennifer: jen jenny | johannes: hans hannes
josefina: pepa josie fina | joseph: joe joey | katherine: kate katie kathy kat kit | konstantin: kostya
lawrence: larry laurie | leonard: len lenny leo | margaret: maggie meg peggy | matthew: matt | maximilian: max
michael: mike mick mickey | nathaniel: nate nat | nicholas: nick nico | olivia: liv livvy | ottilie: tilly ottie
patricia: pat trish patty | penelope: penny | philippa: pippa pip | rebecca: becca becky | richard: rich richie dick rick
robert: bob bobby rob | roderick: rod roddy | rosalind: roz ros | samuel: sam sammy | stephen: steve | susan: sue suzie
theodore: theo ted teddy | thomas: tom tommy | timothy: tim timmy | tobias: toby | ulrich: uli | ursula: ulla
valentina: val | victoria: vicky tori vic | vincent: vince vinny | wilhelmina: mina willa billie
william: bill billy will liam | winifred: winnie freda | xavier: xavi | zachary: zach zack
"""
# Common given names of many countries that have no usual short form (a parameter of the reader, as above); hardly any
# of four letters, which one edit turns into too many other words.
GIVEN = """agnieszka ahmed aisha akiko alejandro amara anita antonio arjun astrid aurelie bjorn carlos carmen chiara clara dario
diego elena emeka enrique farida fatima fernando fiona freya giulia giovanni goran greta hamid hannah hassan helga
hiroshi ibrahim ines ingrid irina jamal javier jorg julia kamal karim keiko kenji kwame laura leila lindiwe lucia
lukasz magnus malik mario marta mehmet miguel mohammed monika nadia noor nuria oskar pablo paolo pavel pedro pierre
priya quentin rafael rahul sakura sandra sanjay sergei silvia sofia soren sunita svetlana tamsin tariq themba tomoko
vikram wei yasmin yusuf zainab zoe zofia"""
# Words that make a name an organisation's: lines of business (the divisions of the public ISIC Rev. 4
# classification in the words that firms use for them), legal forms, partners. They only add to what all rows tell.
BUSINESS = """accounting advertising aerospace agriculture airlines aquaculture architecture automotive bakery banking beverages
biotechnology brewing broadcasting catering cement ceramics chemicals cleaning clothing communications
construction consulting cosmetics dairy design distribution electric electrical electronics energy engineering entertainment
equipment estates exports farming finance financial fisheries foods footwear forestry foundry freight furniture gaming
haulage healthcare holdings hospitality hotels imports industries information instruments insurance investment investments
jewellery laboratories leasing logistics machinery manufacturing marketing materials media metals minerals mining
motors networks nutrition optics packaging petroleum pharmaceuticals plastics plumbing printing properties publishing
railways recycling refining rentals repairs research restaurants retail robotics rubber sanitation sawmills security
semiconductors services shipping shipyards software solutions staffing storage supplies systems technologies
technology telecom telecommunications textiles tobacco tourism trading training transport transportation travel
utilities ventures veterinary warehousing waste wholesale""".split()
KNOWN_LINES = frozenset(BUSINESS)
LEGAL = set("llc oy ltd limited bv gmbh ag inc incorporated sa plc co corp corporation nv ab as srl spa kg pty lp llp".split())
PARTNERS = set("partners sons daughters brothers bros co associates son".split())
LOOSE = {"group", "and", "u", "und", "y", "et", "the", "of"}
# Forms of address, kinds of work, and words that introduce nobody in particular.
ADDRESS = set("dr prof professor mr mrs ms mx miss eng capt captain sir dame rev".split())
WORK = set("planner auditor reviewer lead clerk manager engineer analyst director coordinator assistant officer operator technician steward supplier contact".split())
NOBODY = set("that some someone somebody whoever whatever anyone person unknown tbd tbc na nobody none new".split())
VAGUE_END = set("company auditors contact reviewer desk supplier team people office crew".split())

WORD = re.compile(r"[^\W_]+")
# Of a token: readings of organisations, of persons, with the token at the place of a given name, of a surname.
Evidence = dict[str, tuple[int, int, int, int]]
NOTHING = (0, 0, 0, 0)


def nickname_table(text: str = NICKNAMES, given: str = GIVEN) -> dict[str, frozenset[str]]:
    """Given name or short form -> the formal names it may stand for."""
    table: dict[str, set[str]] = {}
    for part in [*re.split(r"[|\n]", text), *given.split()]:
        formal, _, short = part.partition(":")
        for name in (formal.strip(), *short.split()):
            if name:
                table.setdefault(name, set()).add(formal.strip())
    return {k: frozenset(v) for k, v in table.items()}


class NameReader:
    """Reads names into readings of all their tokens, and readings into forms ``kind|core|other tokens|known tokens``.

    A reading is ``hint|tokens before a comma|the one upper-case token|login|tokens``. A token that was cut off with a
    point (``Mar.``) keeps the point. ``evidence`` is what all rows tell of a token: in how many readings of organisations
    and of persons it stands, and there in how many at the place of a given name and of a surname.
    """

    def __init__(self, nicknames: dict[str, frozenset[str]] | None = None) -> None:
        self.formal = nickname_table() if nicknames is None else nicknames
        self.longest = max(map(len, self.formal), default=0)
        self.near: dict[str, set[str]] = {}
        for name in self.formal:
            if len(name) >= 4:
                for d in deletes(name, 1):
                    self.near.setdefault(d, set()).add(name)
        self.seen: dict[str, str | None] = {}
        self.near_line: dict[str, set[str]] = {}
        self.line_by_first: dict[str, list[str]] = {}
        for word in BUSINESS:
            self.line_by_first.setdefault(word[0], []).append(word)
            for d in deletes(word, 2):
                self.near_line.setdefault(d, set()).add(word)
        self.longest_line = max(map(len, BUSINESS))

    def given(self, token: str) -> str | None:
        """The known given name ``token`` is, perhaps misspelt by one edit; None for other tokens."""
        if token not in self.seen:
            found = token if token in self.formal else None
            if found is None and 4 <= len(token) <= self.longest + 1:
                close = {n for d in deletes(token, 1) for n in self.near.get(d, ()) if distance(token, n, 1) == 1}
                found = min(close) if len(close) == 1 or (close and len({f for n in close for f in self.formal[n]}) == 1) else None
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[token] = found
        return self.seen[token]

    def reading(self, name: str | None, hint: str | None = None) -> str | None:
        text = plain(name or "").strip()
        text = re.sub(r"\([^)]*\)?|\[[^\]]*\]?", " ", text)
        text = re.sub(r"\s+/\s+.*$", " ", text)
        text = re.sub(r"^\s*[A-Z][\w ]{2,40}:\s+", " ", text)
        text = re.sub(r"^\s*(?:ask|contact at|attn|via|cc)\b:?", " ", text, flags=re.I)
        text = re.sub(r"\bfrom\s+(?:the\s+)?[A-Z].*$", " ", text)
        text = re.sub(r"\b((?:[A-Za-z]\.){2,}[A-Za-z]?)(?=\W|$)", lambda m: m[1].replace(".", "") if m[1].replace(".", "").casefold() in LEGAL else m[1], text)
        text = uncamel(text).casefold().replace("&", " and ").replace("+", " and ")
        parts = [p for p in text.split(",") if re.search(r"[^\W\d_]", p)]
        parts = [p for i, p in enumerate(parts) if not i or not any(w in WORK for w in WORD.findall(p))]
        text = " ".join(parts)
        tokens = WORD.findall(text)
        if not tokens or self.nobody(tokens, name or "") or (tokens[0] in ("the", "that", "a") and tokens[-1] in VAGUE_END - {"people"}):
            return None
        cut_off = set(re.findall(r"\b([^\W\d_]{2,3})\.(?=\s|$)", text)) - set(self.formal) - LEGAL - PARTNERS
        split = [[t for t in WORD.findall(p) if t not in ADDRESS and not t.isdigit()] for p in parts]
        tokens, head = [t for p in split for t in p], len(split[0]) if len(split) > 1 else 0
        if tokens and tokens[0] == "the" and not re.match(r"\s*the\.", text):
            tokens, head = tokens[1:], max(0, head - 1)
            if tokens and tokens[-1] == "people":
                tokens = tokens[:-1]
        if not tokens:
            return None
        raw = name or ""
        shout = {w.casefold() for w in re.findall(r"\b[A-Z]{3,}\b", plain(raw))} & set(tokens)
        login = len(tokens) == 1 and len(tokens[0]) >= 7 and tokens[0] in raw
        kind = hint[0] if hint in ("person", "organisation") else ""
        return f"{kind}|{head if head < len(tokens) else 0}|{min(shout) if len(shout) == 1 < len(tokens) else ''}|{int(login)}|{' '.join(t + '.' * (t in cut_off) for t in tokens)}"

    @staticmethod
    def nobody(tokens: list[str], raw: str) -> bool:
        """Whether a name opens like one of nobody in particular. ``na`` opens a name too, ``New`` one whose words are capitals."""
        if tokens[0] not in NOBODY or (tokens[0] == "na" and len(tokens) > 1):
            return False
        words = re.findall(r"[^\W\d_]+", raw)
        return not (tokens[0] == "new" and tokens[-1] not in VAGUE_END and len(words) > 1 and words[0][0].isupper() and words[1][0].isupper())

    def read(self, name: str | None, hint: str | None = None, evidence: Evidence | None = None) -> str | None:
        reading = self.reading(name, hint)
        return self.form(reading, evidence or {}) if reading else None

    def form(self, reading: str, evidence: Evidence) -> str | None:
        """The form of a reading, given the evidence on its tokens."""
        hint, head, shout, login, text = reading.split("|")
        tokens = text.split()
        return self._organisation(tokens, hint, evidence) or self._person(tokens, int(head), shout, login == "1", evidence)

    def line(self, token: str) -> bool:
        """Whether a token is, perhaps misspelt, a line of business of the table."""
        if token in KNOWN_LINES:
            return True
        if not 5 <= len(token) <= self.longest_line + 2 or self.given(token) is not None:
            return False
        most = allowed(len(token))
        return any(distance(token, b, most) <= most for d in deletes(token, most) for b in self.near_line.get(d, ()))

    def shortened(self, token: str) -> bool:
        """Whether a token is a line of business cut short."""
        if token.endswith("."):
            return True
        if len(token) < 3 or self.given(token) is not None:
            return False
        alike = self.line_by_first.get(token[0], ())
        return (len(token) <= 5 and token not in KNOWN_LINES and any(abbreviates(token, b) for b in alike)) or any(b != token and b.startswith(token) for b in alike)

    def _organisation(self, tokens: list[str], hint: str, evidence: Evidence) -> str | None:
        skip = LEGAL | PARTNERS | LOOSE
        rest = [t for t in tokens if t not in skip]
        if not rest:
            return None
        firm = any(t in LEGAL or t in PARTNERS or t == "group" for t in tokens)
        lines = [t for t in rest if self.line(t) or ((firm or hint == "o") and self.shortened(t))] if len(rest) > 1 else []
        people = [t for t in rest if self.given(t)]
        sure = bool(lines and not people) or (firm and not (people and not lines and hint != "o"))
        if not sure and not (hint == "o" and len(rest) == 1):
            o, p = (sum(evidence.get(t, NOTHING)[k] for t in rest) for k in (0, 1))
            if people or any(len(t) == 1 for t in rest) or not o > (p if hint == "o" else 2 * p):
                return None
        core = min([t for t in rest if t not in lines] or rest, key=lambda t: (t.endswith("."), sum(evidence.get(t, NOTHING)[:2]), -len(t) if not evidence else 0))
        rest.remove(core)
        return f"o|{core}|{' '.join(sorted(set(rest) - {core}))}|{' '.join(sorted({t for t in rest if t in KNOWN_LINES}))}"

    def _person(self, tokens: list[str], head: int, shout: str, login: bool, evidence: Evidence) -> str | None:
        kept = [(i < head, t) for i, t in enumerate(tokens) if t not in LEGAL or len(t) == 1 or self.given(t)]
        full = [(before, t) for before, t in kept if len(t) > 1 and not t.endswith(".")]
        if not full:
            return None
        if login and self.is_login(full[0][1], evidence):
            return f"p|{full[0][1][:-1]}|{full[0][1][-1]}|"

        def surname(at: int) -> tuple:
            before, t = full[at]
            _, _, g, s = evidence.get(t, NOTHING)
            sign = math.log((s + 0.5) / (g + 0.5)) + 2 * before + 2 * (t == shout) - (3 if t in self.formal else 2 if self.given(t) else 0)
            return (round(sign, 6), len(t) >= 7 if not evidence else 0, at)

        chosen = full[max(range(len(full)), key=surname)]
        core = chosen[1]
        others = [t for before, t in sorted(kept, key=lambda x: x[0]) if t]
        others.remove(core)
        known = {t for _, t in full if t in self.formal or (len(t) >= 4 and (lambda e: e[2] >= 3 and e[2] > e[3])(evidence.get(t, NOTHING)))}
        return f"p|{core}|{' '.join(others)}|{' '.join(sorted(known))}"

    @staticmethod
    def is_login(token: str, evidence: Evidence) -> bool:
        """Whether a lower-case token is a surname with an initial after it: not if it stands as a name elsewhere."""
        return not sum(evidence.get(token, NOTHING)[2:])

    def names(self, given: str) -> frozenset[str]:
        """The formal names a given token may stand for, itself included."""
        known = self.given(given)
        return (self.formal[known] if known else frozenset()) | {given}

    def open(self, form: str) -> bool:
        """Whether a form leaves the given name or line of business open."""
        kind, _, others, _ = form.split("|")
        rest = others.split()
        if kind == "o":
            return all(self.shortened(t) for t in rest)
        return not rest or len(rest[0]) == 1 or rest[0].endswith(".")

    def keys(self, form: str, bare: bool = False) -> list[tuple[str, str]]:
        """``(token, beginning of another token)`` of all tokens; ``bare``: also the core with ``*``.

        Two forms that agree share such a pair, the tokens up to a few edits. Known tokens are held by many forms and take
        three letters of the other token.
        """
        kind, core, others, known = form.split("|")
        tokens, often = [core, *others.split()], set(known.split())
        out = {(core, "*")} if bare or len(tokens) == 1 else set()
        for i, t in enumerate(tokens):
            if len(t) == 1 or t.endswith("."):
                continue
            for j, other in enumerate(tokens):
                if i == j:
                    continue
                names = self.names(other) if kind == "p" and j else {other}
                if len(other) >= 3 and not other.endswith("."):
                    out |= {(t, n[:3]) for n in names}
                if t not in often:
                    out |= {(t, n[0]) for n in names}
        return sorted(out)

    def edge(self, kind: str, s: str, t: str, known: set[str], cores: int) -> tuple[float, int, int]:
        """``(weight, edits, side)`` of aligning two tokens; side -1 or 1: the first or second only stands for the other."""
        if s == t:
            return 1.0, 0, 0
        if len(s) == 1 or len(t) == 1 or s.endswith(".") or t.endswith("."):
            if cores:
                return 0.0, 0, 0
            side = -1 if len(s) == 1 or (s.endswith(".") and len(t) > 1) else 1
            short, full = (s.rstrip("."), t) if side < 0 else (t.rstrip("."), s)
            fits = any(n.startswith(short) or len(n) == 1 and short.startswith(n) for n in self.names(full)) if kind == "p" else full.startswith(short) or abbreviates(short, full) > 0
            fits = fits or (kind == "p" and len(short) == 1 and full.rstrip(".")[0] == short)
            return (0.5 if fits else 0.0), 0, side
        if kind == "p" and not cores:
            if self.names(s) & self.names(t):
                return 0.9, 0, 0
            short, full = (s, t) if len(s) <= len(t) else (t, s)
            if len(short) <= 4 and short not in known and short not in self.formal and any(n.startswith(short) for n in self.names(full)) and distance(s, t, 1) > (len(short) >= 4):
                return 0.6, 0, -1 if short == s else 1
            if (s in known or self.given(s)) and (t in known or self.given(t)):
                return 0.0, 0, 0
        most = min(allowed(len(s)), allowed(len(t)))
        e = distance(s, t, most)
        if e <= most:
            return 1 - 0.1 * e, e, 0
        if kind == "o" and not cores:
            short, full = (s, t) if len(s) <= len(t) else (t, s)
            if short not in KNOWN_LINES and (len(short) >= 3 and full.startswith(short) or 3 <= len(short) <= 5 and abbreviates(short, full)):
                return 0.5, 0, -1 if short == s else 1
        return 0.0, 0, 0

    def agree(self, a: str, b: str) -> int:
        """How the tokens of two forms align one to one.

        0 not at all, 1 as the same name, 2 ``a`` says less than ``b``, 3 ``b`` says less, 4 each says less at some token;
        ten times the edits of the cores is added.
        """
        kind, core_a, others_a, known_a = a.split("|")
        kind_b, core_b, others_b, known_b = b.split("|")
        if kind != kind_b:
            return 0
        x, y = [core_a, *others_a.split()], [core_b, *others_b.split()]
        known = set(known_a.split()) | set(known_b.split())
        turned = len(x) > len(y)
        if turned:
            x, y = y, x
        edges = [[self.edge(kind, s, t, known, (not i) + (not j)) for j, t in enumerate(y)] for i, s in enumerate(x)]
        pairs = assign([[e[0] for e in row] for row in edges])
        if any(not edges[i][j][0] for i, j in enumerate(pairs)):
            return 0
        # the initial of a given name stands for no middle name
        if kind == "p" and len(x) > 1 and ((len(x[1]) == 1 and pairs[1] != 1) or (len(y[1]) == 1 and 1 in pairs and pairs[1] != 1)):
            return 0
        used = [edges[i][j] for i, j in enumerate(pairs)]
        left = [t for j, t in enumerate(y) if j not in pairs and len(t) > 1]
        whole = sum(not side and len(x[i]) > 1 for i, (_, _, side) in enumerate(used))
        if 0 not in pairs and whole < 2:
            return 0
        core_edits = max(used[0][1], used[pairs.index(0)][1] if 0 in pairs else 0)
        if core_edits > 1 and sum(e for _, e, _ in used) > core_edits:
            return 0
        less_x, less_y = bool(left) or len(x) == 1 < len(y) or any(side < 0 for _, _, side in used), any(side > 0 for _, _, side in used)
        if turned:
            less_x, less_y = less_y, less_x
        return 10 * core_edits + 1 + less_x + 2 * less_y


def node_names(nodes: DataFrame) -> DataFrame:
    """``(key, name, hint)`` of person and organisation nodes: the frontmatter's ``name``, else its ``aliases``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, kind, text in zip(pdf["id"], pdf["type"], pdf["frontmatter"], strict=True):
                try:
                    fm = json.loads(text)
                except (TypeError, ValueError):
                    continue
                if not isinstance(fm, dict):
                    continue
                name = fm.get("name")
                names = [name] if isinstance(name, str) and name.strip() else fm.get("aliases")
                names = names if isinstance(names, list) else [names]
                out += [(key, n, kind) for n in names if isinstance(n, str) and n.strip()]
            yield pd.DataFrame(out, columns=["key", "name", "hint"])

    chosen = nodes.where(F.col("type").isin("person", "organisation")).select("id", "type", "frontmatter").distinct()
    return chosen.mapInPandas(run, "key string, name string, hint string")


def loose_names(unresolved: DataFrame) -> DataFrame:
    """``(key, name, hint)`` of loose ends guessed to be persons or organisations."""
    rows = unresolved.where(F.col("type_guess").isin("person", "organisation") & F.col("loose_id").isNotNull())
    return rows.select(F.concat(F.lit("loose:"), F.col("loose_id").cast("string")).alias("key"), F.col("descriptor").alias("name"), F.col("type_guess").alias("hint"))


def tell(reading: str) -> list[tuple[str, int, int, int, int]]:
    """What one reading tells of each of its tokens: ``(token, *evidence)``."""
    hint, head, shout, login, text = reading.split("|")
    full = [(i, t) for i, t in enumerate(text.split()) if len(t) > 1 and not t.endswith(".")]
    persons = [(i, t) for i, t in full if t not in LEGAL]
    place = {}
    if hint != "o" and len(text.split()) > 1:
        for n, (i, t) in enumerate(persons):
            if shout:
                last = t == shout
            elif int(head):
                last = i < int(head)
            else:
                last = None if 0 < n < len(persons) - 1 else n == len(persons) - 1
            place[t] = last
    told = [(t, int(hint == "o"), int(hint == "p"), int(place.get(t) is False), int(place.get(t) is True)) for t in {t for _, t in full}]
    return told + [(full[0][1][:-1], 0, 0, 0, 0)] * (login == "1")


def read_forms(names: DataFrame) -> DataFrame:
    """``(key, form)``, distinct, of every name that names somebody.

    Names are read twice: first for their tokens, then, with what all rows tell of each token, for the roles of these.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = NameReader.shared()
        for pdf in batches:
            reading = [reader.reading(n, h) for n, h in zip(pdf["name"], pdf["hint"], strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "reading": reading}).dropna()

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(r, *t) for r in pdf["reading"] for t in tell(r)], columns=["reading", "token", "o", "p", "g", "s"])

    @F.pandas_udf("string")
    def form(readings: pd.Series, evidence: pd.Series) -> pd.Series:
        told = lambda es: {} if es is None else {e["token"]: (e["o"], e["p"], e["g"], e["s"]) for e in es}
        return pd.Series([NameReader.shared().form(r, told(es)) for r, es in zip(readings, evidence, strict=True)], dtype="object")

    read = cut(names.select("key", "name", "hint").where("name IS NOT NULL").mapInPandas(run, "key string, reading string").distinct())
    once = read.select("reading").distinct()
    told = cut(once.mapInPandas(tokens, "reading string, token string, o long, p long, g long, s long"))
    evidence = told.groupBy("token").agg(*(F.sum(c).alias(c) for c in "opgs"))
    known = told.select("reading", "token").join(evidence, "token").groupBy("reading").agg(F.collect_list(F.struct("token", "o", "p", "g", "s")).alias("evidence"))
    forms = cut(once.join(known, "reading", "left").select("reading", form("reading", "evidence").alias("form")))
    return read.join(forms.where("form IS NOT NULL"), "reading").select("key", "form").distinct()


def near_cores(cores: DataFrame) -> DataFrame:
    """``(a, b, edits)`` of all distinct cores of a kind within the allowed edits, both ways and with themselves."""

    @F.pandas_udf("array<string>")
    def variants(cores: pd.Series) -> pd.Series:
        return cores.map(lambda c: sorted(near_keys(c, allowed(len(c)))))

    @F.pandas_udf("int")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([distance(x, y, min(allowed(len(x)), allowed(len(y)))) for x, y in zip(a, b, strict=True)], dtype="int32")

    index = cores.select("kind", "core", F.explode(variants("core")).alias("v")).select("kind", "core", F.xxhash64("v").alias("h"))
    left, right = index.select("kind", "h", F.col("core").alias("a")), index.select("kind", "h", F.col("core").alias("b"))
    pairs = left.join(right, ["kind", "h"]).where("a < b").select("kind", "a", "b").distinct()
    most = lambda c: F.when(F.length(c) < 4, 0).when(F.length(c) < 7, 1).otherwise(2)
    close = pairs.withColumn("edits", edits("a", "b")).where(F.col("edits") <= F.least(most("a"), most("b")))
    both = close.unionByName(close.select("kind", F.col("b").alias("a"), F.col("a").alias("b"), "edits"))
    return both.unionByName(cores.select("kind", F.col("core").alias("a"), F.col("core").alias("b"), F.lit(0).alias("edits")))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(form, label)``: the least form of each connected component, by label propagation with pointer jumping to a fixpoint."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    linked = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("form"), F.least("a", "m").alias("label"))
    linked = cut(linked)
    while True:
        heard = both.join(linked.select(F.col("form").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = linked.join(heard, linked["form"] == heard["a"], "left").select("form", "label", F.least("label", F.coalesce("m", "label")).alias("next"))
        jump = linked.select(F.col("form").alias("next"), F.col("label").alias("far"))
        step = step.join(jump, "next", "left").select("form", "label", F.least("next", F.coalesce("far", "next")).alias("next"))
        step = cut(step)
        linked = step.select("form", F.col("next").alias("label"))
        if step.where("label <> next").isEmpty():  # labels only fall, so this comes
            break
    return vertices.join(linked, "form", "left").select("form", F.coalesce("label", "form").alias("label"))


def candidates(left: DataFrame, right: DataFrame, near: DataFrame, bare_left: bool, bare_right: bool) -> DataFrame:
    """``(x, y)``: forms that hold near tokens beside other tokens of the same beginning."""

    def keyed(forms: DataFrame, bare: bool) -> DataFrame:
        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = NameReader.shared()
            for pdf in batches:
                yield pd.DataFrame([(kind, form, *key) for kind, form in zip(pdf["kind"], pdf["form"], strict=True) for key in reader.keys(form, bare)], columns=["kind", "form", "t", "k"])

        return forms.select("kind", "form").mapInPandas(keys, "kind string, form string, t string, k string")

    a = keyed(left, bare_left).withColumnsRenamed({"form": "x", "t": "a"}).join(near, ["kind", "a"])
    b = keyed(right, bare_right).withColumnsRenamed({"form": "y", "t": "b"})
    return a.join(b, ["kind", "b", "k"]).where("x <> y").select("x", "y").distinct()


def agreement(x: str, y: str) -> Column:
    """``NameReader.agree`` of two columns."""

    @F.pandas_udf("int")
    def how(a: pd.Series, b: pd.Series) -> pd.Series:
        reader = NameReader.shared()
        return pd.Series([reader.agree(p, q) for p, q in zip(a, b, strict=True)], dtype="int32")

    return how(x, y)


def grouped(forms: DataFrame, near: DataFrame, bare: bool = False) -> DataFrame:
    """``(form, label)``: forms that align as the same name, closed over; a group that says less joins the one that it fits."""
    pairs = candidates(forms, forms, near, bare, bare).where("x < y").withColumn("how", agreement("x", "y"))
    pairs = cut(pairs.select("x", "y", (F.col("how") % 10).alias("how"), F.floor(F.col("how") / 10).alias("edits")).where("how BETWEEN 1 AND 3"))
    groups = cut(components(forms.select("form"), pairs.where("how = 1").select(F.col("x").alias("a"), F.col("y").alias("b"))))
    less = pairs.where("how = 2").select("x", "y", "edits").unionByName(pairs.where("how = 3").select(F.col("y").alias("x"), F.col("x").alias("y"), "edits"))
    of = lambda c, name: groups.select(F.col("form").alias(c), F.col("label").alias(name))
    fits = less.join(of("x", "a"), "x").join(of("y", "b"), "y").where("a <> b").groupBy("a", "edits").agg(F.min("b").alias("b"), F.max("b").alias("far"))
    fits = fits.groupBy("a").agg(F.min_by(F.struct("b", "far"), "edits").alias("f")).select("a", "f.b", "f.far")
    wider = components(groups.select(F.col("label").alias("form")).distinct(), fits.where("b = far").select("a", "b"))
    return groups.withColumnRenamed("label", "old").join(wider.withColumnRenamed("form", "old"), "old").select("form", "label")


def link_forms(forms: DataFrame) -> DataFrame:
    """``(form, label)``: the group of every form that is in one."""

    @F.pandas_udf("boolean")
    def is_open(forms: pd.Series) -> pd.Series:
        return forms.map(NameReader.shared().open).astype("bool")

    part = F.split("form", r"\|")
    rows = cut(forms.select("form").distinct().select("form", part[0].alias("kind"), part[1].alias("core"), part[2].alias("others"), is_open("form").alias("open")))
    words = rows.select("kind", F.explode(F.concat(F.array("core"), F.split("others", " "))).alias("core")).where("length(core) > 1")
    near = cut(near_cores(words.distinct()))
    whole, some = rows.where("NOT open").select("kind", "form"), rows.where("open").select("kind", "form")
    groups = cut(grouped(whole, near))

    # open names: the one group that fits, nearest cores first
    fits = candidates(some, whole, near, False, True).withColumn("how", agreement("x", "y")).where("how > 0")
    fits = fits.join(groups.withColumnRenamed("form", "y"), "y").select("x", F.floor(F.col("how") / 10).alias("edits"), "label").distinct()
    nearest = fits.groupBy("x", "edits").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))
    nearest = cut(nearest.groupBy("x").agg(F.min_by(F.struct("label", "n"), "edits").alias("f")).select("x", "f.label", "f.n"))
    joined = nearest.where("n = 1").select(F.col("x").alias("form"), "label")

    # open names that fit no group: among themselves in the same way
    alone = some.join(nearest, F.col("form") == F.col("x"), "left_anti")
    mates = grouped(alone, near, bare=True)
    return groups.unionByName(joined).unionByName(mates)


_READERS: list[NameReader] = []


def _shared() -> NameReader:
    if not _READERS:
        _READERS.append(NameReader())
    return _READERS[0]


NameReader.shared = staticmethod(_shared)


def entity_groups(names: DataFrame) -> DataFrame:
    """``(key, label)``: every record that names somebody with its group's label; its number of links is its group's size."""
    forms = cut(read_forms(names))
    return forms.join(link_forms(forms), "form").select("key", "label").distinct()


def entity_pairs(names: DataFrame) -> DataFrame:
    """``(key_a, key_b)``: every pair of records that name the same one, the smaller key (by UTF-8 bytes) first."""
    rows = cut(entity_groups(names))
    several = rows.groupBy("label").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("label")
    rows = rows.join(several, "label", "left_semi")
    a, b = rows.select("label", F.col("key").alias("key_a")), rows.select("label", F.col("key").alias("key_b"))
    return a.join(b, "label").where("key_a < key_b").select("key_a", "key_b").distinct()
