"""Personal data by weak supervision.

Every text is scanned once, for the four base kinds (whose spans always stay) and for candidates: words that hold digits, '@', '=' or a
written-out '(at)', and runs of digit groups between blanks.
Labelers vote on each candidate: patterns (regular expressions), gazetteers (lists of words and endings) and contexts (the words
before). Expectation-maximisation over the counts of vote patterns, taken from all documents, estimates how often each labeler is
right; the posteriors train a linear classifier over the candidates' features, again over counts of all feature patterns; and the
classifier decides, so a candidate on which no labeler votes is still judged by its form. What is accepted becomes a span.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrays import map_slices

BASE = ("email", "ip", "card", "phone")
ACCEPT, SHORTEST = 0.5, 5
#: A labeler is taken to vote wrongly on at most this share of a class.
MOST_WRONG = 0.02

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@=]|\(at\)|\[at\]")
CANDIDATE = re.compile(r"(?<!\S)(?=\S*(?:[0-9@=]|\(at\)|\[at\]))\S++")
AT = re.compile(r"@|\(at\)|\[at\]")
#: Digit groups with one blank between them, as in '123 45 6789' or '(020) 7946 0958'.
GROUP = r"(?:\([0-9]++\)|[0-9]++)(?:[.-][0-9]++)*+"
GROUPED = re.compile(rf"(?<!\S)[\"'\[{{<(]*?(\+?{GROUP}(?:[\x20\xA0]{GROUP}(?=[\"')\]}}>,;:.!?]*+(?:\s|\Z)))++)")

# ---- gazetteers (fixed values) ----
SECRET_NAMES = frozenset("password passwd pwd secret token apikey api_key access_key auth bearer passphrase".split())
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "AIza", "eyJ")
CONTACT_WORDS = frozenset("email mail e-mail phone tel telephone mobile call fax contact reach correo telefon téléphone".split())
ACCOUNT_WORDS = frozenset("ssn iban account card passport licence id login user username key".split())
PLAIN_WORDS = frozenset("version v page pages chapter section figure table no number nr year step line room vol part by cc".split())

LABELERS = ("key form", "hex form", "short number", "version form", "secret name", "key prefix", "plain word before", "contact word before", "account word before", "inside base span", "address form", "failed check")
KEY_FORM = re.compile(r"(?=[A-Za-z0-9_/+-]*[0-9])(?=[A-Za-z0-9_/+-]*[A-Z])[A-Za-z0-9_/+-]{16,}\Z")
HEX_FORM = re.compile(r"(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}\Z")
VERSION_FORM = re.compile(r"[vV]?[0-9]{1,3}(?:\.[0-9]{1,3}){0,2}\Z")
ADDRESS_FORM = re.compile(r"[\w.%+-]+(?:@|\(at\)|\[at\])[\w-]+(?:(?:\.|\(dot\)|\[dot\])[\w-]+)+\Z")
GOOD, BAD, NONE = 1, 2, 0


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * d - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def emails(text: str):
    """Leftmost matches of local part '@' domain, found from each '@' so that long runs without one cost nothing."""
    start, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        begin = at
        if domain:
            while begin > start and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
                begin -= 1
            if begin < at:
                yield begin, domain.end()
                start = domain.end()
        at = text.find("@", max(at + 1, start))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and start; code points, end exclusive."""
    return checked_spans(text)[0]


def checked_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[list[int], list[int]]]]:
    """Spans of the base kinds, and starts and ends of what a base pattern matched and its check refused, for each pattern. Numbers that
    are too short or too long for a card are no refused cards."""
    found, refused = [("email", a, b) for a, b in emails(text)], []

    def check(kind, pattern, accepts):
        starts, ends = [], []
        for m in pattern.finditer(text):
            good = accepts(m.group())
            if good:
                found.append((kind, m.start(), m.end()))
            elif good is not None:
                starts.append(m.start())
                ends.append(m.end())
        refused.append((starts, ends))

    def card(value):
        digits = value.replace(" ", "").replace("-", "")
        return luhn(digits) if 13 <= len(digits) <= 19 else None

    check("ip", IP, lambda value: all(len(p.lstrip("0")) <= 3 and int(p[-4:] or 0) <= 255 for p in value.split(".")))
    check("card", CARD, card)
    check("phone", PHONE, lambda value: 9 <= sum(c in "0123456789" for c in value) <= 15)
    return found, refused


def within(spans: list[tuple[list[int], list[int]]], start: int, end: int) -> bool:
    return any((k := bisect_right(starts, start)) and end <= ends[k - 1] for starts, ends in spans)


def core(word: str) -> tuple[int, int]:
    """Start and end of the word without quotes and marks around it."""
    left = len(word) - len(word.lstrip("\"'([{<,;:.!?#$%&*|"))
    return left, max(left, len(word.rstrip("\"')]}>,;:.!?#$%&*|")))


def secret_part(value: str) -> str:
    """What stands after '=' and the name of a secret, or the value itself."""
    name, _, rest = value.partition("=")
    return rest if rest and name.lower().strip("-") in SECRET_NAMES else value


def votes(value: str, before: list[str], in_base: bool, refused: bool) -> list[int]:
    secret = secret_part(value)
    digits = sum(c.isdigit() for c in value)
    near = {w.strip(".,:;!?()\"'").lower() for w in before}
    return [
        GOOD if KEY_FORM.match(secret) else NONE,
        GOOD if HEX_FORM.match(secret) else NONE,
        BAD if digits < 5 and len(value) < 12 and not AT.search(value) and "=" not in value else NONE,
        BAD if VERSION_FORM.match(value) else NONE,
        GOOD if secret is not value and len(secret) >= 6 else NONE,
        GOOD if secret.startswith(KEY_PREFIXES) and len(secret) >= 16 else NONE,
        BAD if near & PLAIN_WORDS else NONE,
        GOOD if near & CONTACT_WORDS and digits + 5 * bool(AT.search(value)) >= 5 else NONE,
        GOOD if near & ACCOUNT_WORDS and digits >= 5 else NONE,
        GOOD if in_base else NONE,
        GOOD if ADDRESS_FORM.match(value) else NONE,
        BAD if refused and not in_base else NONE,  # a base pattern matched, and its check refused it
    ]


def form(value: str) -> int:
    """The candidate's features as one number: length, share of digits, share of capitals, '@', '=', '.', and letters mixed with digits."""
    size = len(value) or 1
    digits, capitals, letters = (sum(map(f, value)) for f in (str.isdigit, str.isupper, str.isalpha))
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))
    parts = [min(7, size // 4), min(4, 5 * digits // size), min(2, 3 * capitals // size), "@" in value, "=" in value, min(3, value.count(".")), min(2, switches // 3), letters > 0]
    out = 0
    for part, base in zip(parts, FORM_SIZES):
        out = out * base + int(part)
    return out


FORM_SIZES = (8, 5, 3, 2, 2, 4, 3, 2)


def one_hot(forms: np.ndarray) -> np.ndarray:
    columns = []
    for base in reversed(FORM_SIZES):
        columns.append(np.eye(base)[forms % base])
        forms = forms // base
    return np.hstack(columns)


def kind_of(value: str) -> str:
    if AT.search(value):
        return "contact"
    return "secret" if any(c.isalpha() for c in value) else "number"


def scan(text: str) -> tuple[list, list]:
    """Base spans, and candidates (kind, start, end, votes as one number, form)."""
    if not MARKED.search(text):
        return [], []
    base, refused = checked_spans(text)
    found = []
    words = ((m.start() + k for k in core(m.group())) for m in CANDIDATE.finditer(text))
    for start, end in chain(words, (m.span(1) for m in GROUPED.finditer(text))):
        value = text[start:end]
        if len(value) < SHORTEST or not (any(c.isdigit() for c in value) or AT.search(value) or secret_part(value) is not value):
            continue
        before = text[max(0, start - 60) : start].split()[-2:]
        inside = any(a < end and start < b for _, a, b in base)
        code = 0
        for vote in votes(value, before, inside, within(refused, start, end)):
            code = code * 3 + vote
        found.append((kind_of(value), start, end, code, form(value), inside))
    return base, found


def _scan():
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    candidate = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int64()), ("form", pa.int64()), ("inside", pa.bool_())])
    names, more = [f.name for f in kind], [f.name for f in candidate]

    def fn(batch, data, offsets):
        raw = data.tobytes()
        found = [scan(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        base = pa.array([[dict(zip(names, x)) for x in b] for b, _ in found], pa.list_(kind))
        rest = pa.array([[dict(zip(more, x)) for x in c] for _, c in found], pa.list_(candidate))
        return pa.RecordBatch.from_arrays([batch.column(0), base, rest], ["doc_id", "base", "candidates"])

    return map_slices(fn)


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior that a candidate with these votes is personal data. Classes start from the balance of votes."""
    table = codes[:, None] // 3 ** np.arange(len(LABELERS))[::-1] % 3
    hot = np.eye(3)[table]
    balance = (table == GOOD).sum(1) - (table == BAD).sum(1)
    good = 1 / (1 + np.exp(-2.0 * balance - 0.5 * (balance == 0) * -1.0))
    for _ in range(rounds):
        chance = []
        for weight, likely in ((counts * good, GOOD), (counts * (1 - good), BAD)):
            # two doubtful votes on the right side keep a labeler that never votes from counting against its class
            tally = np.einsum("p,plv->lv", weight, hot) + np.where(np.arange(3) == likely, 1.0, 0.5)
            rates = tally / tally.sum(1, keepdims=True)
            wrong = BAD if likely == GOOD else GOOD
            rates[:, wrong] = np.minimum(rates[:, wrong], MOST_WRONG)  # classes cannot change places
            chance.append(rates / rates.sum(1, keepdims=True))
        share = np.clip((counts @ good) / counts.sum(), 0.01, 0.99)
        logs = [np.log(s) + np.einsum("plv,lv->p", hot, np.log(c)) for s, c in zip((share, 1 - share), chance)]
        good = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
    return good


def fit(forms: np.ndarray, target: np.ndarray, counts: np.ndarray, rounds: int = 800, rate: float = 0.1) -> np.ndarray:
    """Weights of a logistic classifier over forms, on soft labels, each pattern weighing the log of its count; the last is the bias."""
    x = np.hstack([one_hot(forms), np.ones((len(forms), 1))])
    weight = np.log1p(counts) / np.log1p(counts).sum()
    weights, first, second = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
        step = x.T @ (weight * (p - target)) + 1e-4 * weights
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        weights -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return weights


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row for each row of docs: doc_id, base and added, arrays of (kind, start, end) in code points, end exclusive.

    base has the four base kinds in order, then by start: leftmost matches that do not overlap within a kind, and of these the valid
    ones. added has what the classifier accepts outside of base spans: kinds contact, number, secret, by kind and start; a number
    of several groups may hold one that is accepted by itself. A null text is empty. Ids may be null or repeat. Other columns are not looked at. Counts, reliabilities and the classifier come from all rows.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    span = "kind:string,start:long,end:long"
    found = source.mapInArrow(_scan(), f"doc_id {kind}, base array<struct<{span}>>, candidates array<struct<{span},votes:long,form:long,inside:boolean>>")
    found = cut_lineage(found)
    pairs = found.select(F.explode("candidates").alias("c")).groupBy("c.votes", "c.form").agg(F.count(F.lit(1)).alias("n"))
    table = pairs.orderBy("votes", "form").toPandas()  # patterns of votes and forms: bounded by their numbers of values
    accepted = []
    if len(table):
        by_votes = table.groupby("votes")["n"].sum()
        posterior = estimate(by_votes.index.to_numpy(), by_votes.to_numpy(float))
        table["target"] = table["votes"].map(dict(zip(by_votes.index, posterior)))
        table["weighted"] = table["target"] * table["n"]
        forms = table.groupby("form")[["n", "weighted"]].sum()
        target = (forms["weighted"] / forms["n"]).to_numpy()
        weights = fit(forms.index.to_numpy(), target, forms["n"].to_numpy(float))
        # votes and form of a candidate are two views of it; their log odds add, the form's prior share being counted once
        share = (table["weighted"].sum() + 1) / (table["n"].sum() + 2)
        z = np.hstack([one_hot(table["form"].to_numpy()), np.ones((len(table), 1))]) @ weights
        odds = np.clip(table["target"], 1e-6, 1 - 1e-6)
        total = z + np.log(odds / (1 - odds)) - np.log(share / (1 - share))
        accepted = table[total > np.log(accept / (1 - accept))]
        accepted = [(int(v) << 20) | int(f) for v, f in zip(accepted["votes"], accepted["form"])]
    added = F.filter("candidates", lambda c: ~c["inside"] & F.shiftleft(c["votes"], 20).bitwiseOR(c["form"]).isin(accepted))
    added = F.array_sort(F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    return found.select("doc_id", "base", added.alias("added"))


def as_text(spans):
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
