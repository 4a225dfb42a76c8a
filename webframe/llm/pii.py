"""Personal data: overlapping candidate spans, scored by boosted trees, chosen by calibrated thresholds.

Base spans follow fixed formats and always stay. Further generators propose spans of looser formats:
emails written with (at) and (dot) or without a dot in the host, numbers like phones without a country
code, identity and account numbers. They may overlap each other and base spans. Trees score each candidate
by its format (digits, separators, checksums) and context (words before it, neighbouring characters). They
learn from the spans whose format check settles the matter: base spans, and look-alikes that fail it.
The sample for that is bounded (`sample` candidates, the smallest by a hash of id, kind and place) and
spread over all rows; a fifth of it is held out to calibrate probabilities and to choose the threshold
at which `precision` is reached. Unsettled candidates above it that touch no settled span are added, the
most probable first where they overlap each other; a look-alike that fails its check is never added.
A format may run on into a neighbour and fail for that, such as a phone number before a card number. What is
left when found spans are taken out is searched again, until nothing more is found; these spans are settled and
added, and so are account numbers whose checksum is right. On demand (`secrets`), values that are given to a password, token
or key (`password=...`, `token = "..."`: eight characters or more, in quotes or with a digit) are settled spans as well.

Spans count code points, ends exclusive. Null texts have no spans and stay null when redacted. Every row is
judged on its own, so repeated rows and ids do no harm. Every scan is linear in the text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.llm.shared import blocks_of
from webframe.llm.trees import Trees, boost, calibrate

#: Fixed order of the base kinds; the kinds that only generators propose follow.
KINDS = ("email", "ip", "card", "phone", "id")
BASE = KINDS[:4]
CLUES = {
    "email": ("mail", "contact", "correo", "courriel", "write", "@"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "whatsapp"),
    "id": ("ssn", "iban", "passport", "account", "konto", "social", "tax"),
}
#: What a secret is given to, at the end of a name such as db_password.
SECRET = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "secret_key", "private_key")
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,p:float>>"


class Finder:
    """Base spans and candidates of one text."""

    def __init__(self):
        self.local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
        self.host = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
        self.loose_host = re.compile(r"[A-Za-z0-9-]{2,63}")
        self.at_word = re.compile(r" ?[\[({] ?(?:at|arroba) ?[\])}] ?")
        self.dot_host = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({] ?(?:dot|punto) ?[\])}] ?)[A-Za-z0-9-]{1,63}){1,8}")
        self.chain = re.compile(r"[0-9]+(?:\.[0-9]+)*")
        self.digits = re.compile(r"[0-9](?:[ -]?[0-9])+")
        self.plus = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
        self.number = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9])+")
        self.account = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
        self.any_digit = re.compile(r"[0-9]")
        self.given = re.compile(r"""[=:][ ]?(?:(["'])([^\s"']{8,})\1|([A-Za-z0-9_+/.~!@#$%^&*-]{8,}))""")
        self.run_on = False  # whether the last text held more digits in one run than a card number has
        # in groups, a hyphen binds a group to its neighbour
        grouped = r"[3-6][0-9]{3}(?:([ -])[0-9]{4}(?:\2[0-9]{4}){2}|([ -])[0-9]{6}\3[0-9]{5})"
        self.whole_card = re.compile(rf"(?<![0-9])(?=([0-9]{{13,19}}(?![0-9])|(?<![0-9]-){grouped}(?![0-9]|-[0-9])))")

    def _left(self, text: str, at: int, floor: int) -> int:
        while at > floor and text[at - 1] in self.local:
            at -= 1
        return at

    def emails(self, text: str) -> tuple[list, list]:
        base, loose, done, at = [], [], 0, text.find("@")
        while at >= 0:
            start = self._left(text, at, done)
            if start < at:
                m = self.host.match(text, at + 1)
                if m:
                    done = m.end()
                    base.append(("email", start, done))
                elif m := self.loose_host.match(text, at + 1):
                    loose.append(("email", start, m.end()))
            at = text.find("@", max(at + 1, done))
        if "at" in text or "arroba" in text:
            for m in self.at_word.finditer(text):
                start, after = self._left(text, m.start(), max(0, m.start() - 64)), self.dot_host.match(text, m.end())
                if start < m.start() and after:
                    loose.append(("email", start, after.end()))
        return base, loose

    @staticmethod
    def luhn(digits: str) -> bool:
        twice = sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))
        return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0

    @staticmethod
    def _part_ok(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) <= 3 and (not part or int(part) <= 255)

    def numbers(self, text: str) -> tuple[list, list, list]:
        """Base spans, look-alikes that fail a check, and looser candidates."""
        base, failed, loose = [], [], []
        for m in self.chain.finditer(text):
            if m.group().count(".") < 3:
                continue
            ends = [x.span() for x in re.finditer(r"[0-9]+", m.group())]
            for i in range(0, len(ends) - 3, 4):
                four = ends[i : i + 4]
                span = ("ip", m.start() + four[0][0], m.start() + four[3][1])
                (base if all(self._part_ok(m.group()[a:b]) for a, b in four) else failed).append(span)
        for m in self.digits.finditer(text):
            if m.end() - m.start() < 12:
                continue
            d = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19:
                (base if self.luhn(d) else failed).append(("card", m.start(), m.end()))
            self.run_on |= len(d) > 19
        if "+" in text:
            for m in self.plus.finditer(text):
                n = sum(c.isdigit() for c in m.group())
                (base if 9 <= n <= 15 else failed).append(("phone", m.start(), m.end()))
        for m in self.number.finditer(text):
            shown = m.group()
            if len(shown) < 7 or len(shown) > 40:
                continue
            n = sum(c.isdigit() for c in shown)
            if 7 <= n <= 15 and n < len(shown):
                loose.append(("phone", m.start(), m.end()))
            if n == 9 and re.fullmatch(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}", shown):
                loose.append(("id", m.start(), m.end()))
        for m in self.account.finditer(text):
            loose.append(("id", m.start(), m.end()))
        return base, failed, loose

    def __call__(self, text: str) -> tuple[list, list, list]:
        base, loose = self.emails(text)
        failed, self.run_on = [], False
        if self.any_digit.search(text):
            more, failed, rest = self.numbers(text)
            base, loose = base + more, loose + rest
        return base, failed, loose

    def _cards(self, text: str) -> list:
        """Card numbers written as cards are, whatever digits stand before or after."""
        out, done = [], 0
        for m in self.whole_card.finditer(text):
            a, b = m.span(1)
            if a >= done and self.luhn(m.group(1).replace(" ", "").replace("-", "")):
                out.append(("card", a, b))
                done = b
        return out

    def _phones(self, text: str) -> list:
        """Of what has too many digits for a phone number, the most that has not, up to a space."""
        out = []
        for m in self.plus.finditer(text):
            n, end, before = 0, 0, ""
            for i, c in enumerate(m.group()):
                if c == " " and before.isdigit() and 9 <= n <= 15:
                    end = m.start() + i
                n, before = n + c.isdigit(), c
                if n > 15:
                    break
            if n > 15 and end:
                out.append(("phone", m.start(), end))
        return out

    def run_together(self, text: str, base: list) -> list:
        """Further spans that pass a check, beside the base spans: those of numbers that follow one another so closely that
        one match takes in several and fails. Found spans are blotted out and the rest is searched again."""
        out, found, left = [], base, list(text)
        while True:
            for _, a, b in found:
                left[a:b] = "\0" * (b - a)
            text = "".join(left)
            found = self.numbers(text)[0] or self._cards(text) or self._phones(text)
            if not found:
                return out
            out += found

    def secrets(self, text: str) -> list:
        out = []
        for m in self.given.finditer(text):
            name = text[max(0, m.start() - 24) : m.start()].rstrip(" \"'").lower()
            quoted = m.group(2) is not None
            if name.endswith(SECRET) and (quoted or self.any_digit.search(m.group(3))):
                out.append(("secret", *m.span(2 if quoted else 3)))
        return out

    @staticmethod
    def account_ok(shown: str) -> bool:
        packed = shown.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1

    def features(self, text: str, span: tuple[str, int, int]) -> list[float]:
        kind, a, b = span
        shown, before, after = text[a:b], text[max(0, a - 24) : a].lower(), text[b : b + 12]
        digits = [c for c in shown if c in "0123456789"]
        left, right = before[-1:], after[:1]
        n = max(1, b - a)
        rank = KINDS.index(kind)
        packed = "".join(c for c in shown if c.isalnum())
        check = 0.0
        if len(packed) > 14 and packed[:2].isalpha() and packed.isascii():
            moved = "".join(str(int(c, 36)) for c in packed[4:] + packed[:4])
            check = float(int(moved) % 97 == 1)
        return [
            *(float(rank == i) for i in range(len(KINDS))),
            float(n), float(len(digits)), len(digits) / n, float(sum(c in " -" for c in shown)),
            float(sum(c in "()" for c in shown)), float(shown.count(".")), float("@" in shown),
            float(shown.startswith("+")), float(len(set(digits))),
            float(bool(digits) and len(digits) <= 32 and self.luhn("".join(digits))), check,
            float(max((len(p) for p in re.findall(r"[0-9]+", shown)), default=0)),
            float(left.isalnum()), float(left in ("=", "/", "#", "_", '"')), float(right.isalnum()),
            float(right in ("/", "_", "=", "%", '"')), float(left.isspace() or not left),
            float(right.isspace() or right in ".,;:!?" or not right),
            float(any(w in before for w in CLUES[kind])),
            float(any(w in before for k, v in CLUES.items() if k != kind for w in v)),
            sum(c.isdigit() for c in before) / 24, sum(c.isdigit() for c in after) / 12,
        ]


WIDTH = len(KINDS) + 22


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, start, stop, label (1 base, 0 fails its check, null unsettled) and x, the features."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, kind string, start int, stop int, label int, x array<double>"

    def run(batches):
        find = Finder()
        names = ["doc_id", "kind", "start", "stop", "label", "x"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
        for part in blocks_of(batches, "text", 8 << 20):
            out = []
            for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                for label, spans in zip((1, 0, None), find(t) if t else ()):
                    out.extend((i, *s, label, find.features(t, s)) for s in spans)
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, types)], names)

    return rows.mapInArrow(run, schema)


def fit(found: DataFrame, sample: int = 20_000, precision: float = 0.98) -> tuple[Trees, float]:
    """Trees and the threshold, from the `sample` settled candidates with the smallest hashes."""
    order = F.xxhash64("doc_id", "kind", "start", "stop")
    rows = found.filter("label is not null").select("label", "x", order.alias("o")).orderBy("o", "label").limit(sample).collect()
    rows = sorted((r.o, r.label, r.x) for r in rows)
    x = np.array([r[2] for r in rows], float).reshape(-1, WIDTH)
    y = np.array([r[1] for r in rows], float)
    held = np.arange(len(y)) % 5 == 4
    pos, neg = max(1.0, y[~held].sum()), max(1.0, (1 - y[~held]).sum())
    weight = np.where(y > 0, (pos + neg) / (2 * pos), (pos + neg) / (2 * neg))
    model = calibrate(boost(x[~held], y[~held], weight[~held]), x[held], y[held])
    p = model.probability(x[held])
    threshold = 0.5
    for cut in np.linspace(0.5, 0.99, 50):
        chosen = p >= cut
        threshold = float(cut)
        if not chosen.any() or y[held][chosen].mean() >= precision:
            break
    return model, threshold


def spans_of(find: Finder, text: str, model: Trees, threshold: float, secrets: bool = False) -> list[dict]:
    """Base spans, other settled ones, and the candidates chosen beside them, by start."""
    base, failed, others = find(text)
    out = [{"kind": k, "start": a, "end": b, "base": True, "p": 1.0} for k, a, b in base]
    more = find.run_together(text, base) if failed or find.run_on else []
    more += find.secrets(text) if secrets else []
    more += [(k, a, b) for k, a, b in others if k == "id" and text[a].isalpha() and find.account_ok(text[a:b])]
    out += [{"kind": k, "start": a, "end": b, "base": False, "p": 1.0} for k, a, b in more]
    if others:
        taken = [(a, b) for _, a, b in base + failed + more]
        p = model.probability(np.array([find.features(text, s) for s in others]))
        for i in sorted(range(len(others)), key=lambda i: (-p[i], others[i][1], -others[i][2], KINDS.index(others[i][0]))):
            k, a, b = others[i]
            if p[i] >= threshold and all(b <= s or e <= a for s, e in taken):
                taken.append((a, b))
                out.append({"kind": k, "start": a, "end": b, "base": False, "p": float(p[i])})
    return sorted(out, key=lambda s: (s["start"], (*KINDS, "secret").index(s["kind"]), s["end"]))


def personal_data(docs: DataFrame, model: Trees, threshold: float, text: str = "text", secrets: bool = False) -> DataFrame:
    """docs as a struct column `row`, and spans: kind, start, end, base, p. `secrets`: those of kind secret as well."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    kept = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("p", pa.float32())]))

    def run(batches):
        find = Finder()
        for part in blocks_of(batches, "text", 8 << 20):
            spans = [spans_of(find, t, model, threshold, secrets) if t else [] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(spans, kept)], ["row", "spans"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, spans {SPAN}")


def redacted(found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `personal_data` with each run of spans in the text replaced by its first kind, as in [EMAIL]."""

    def piece(state: Column, span: Column) -> Column:
        first = F.greatest(span["start"], state["at"])
        apart = span["start"] >= state["at"]
        gap = F.substring(F.col(f"row.`{text}`"), state["at"] + 1, first - state["at"])
        mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return F.struct(
            F.when(apart, F.concat(state["out"], gap, mark)).otherwise(state["out"]).alias("out"),
            F.greatest(span["end"], state["at"]).alias("at"),
        )

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    tail = F.substring(F.col(f"row.`{text}`"), F.col("_done.at") + 1, F.lit(2**31 - 1))
    done = found.withColumn("_done", F.aggregate("spans", begin, piece)).withColumn(
        "_text", F.when(F.size("spans") == 0, F.col(f"row.`{text}`")).otherwise(F.concat("_done.out", tail))
    )
    names = found.schema["row"].dataType.names
    return done.select(*[(F.col("_text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in names])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
