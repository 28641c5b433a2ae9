"""Personal data by bootstrapped contextual extraction.

Seeds are what four fixed formats find (e-mail, ip, card, phone). Every identifier-like token of a text (with a
digit or an @, without the punctuation around it; groups of digits and capitals may be apart by one blank) is
an instance; the two words before an occurrence and the two after it are its lexical patterns, whatever its
form. Patterns and instances form a graph of distinct edges. Spark scores it in rounds: a pattern scores the share of its
instances' weight that belongs to a kind, an instance the noisy-or of its other patterns, so that no pattern
raises itself. Patterns of high confidence, with enough different seeds, then mark instances that no format knows. Marked spans are added
to the fixed ones, which stay as they are.

Edges are aggregated before they move, hot patterns are split by adaptive joins, and a document gets back
only its own marked spans, so nothing grows with a pattern's frequency.

Defined cases: null text is empty; rows that repeat are judged one by one and get the same spans; an empty
table gives an empty result; extra columns are not read.
"""

import hashlib
import re
import string
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.words import listed, map_rows
from panelwright.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
CONFIDENCE = 0.9  # of a pattern whose instances are marked
SUPPORT = 5  # different seed instances a pattern needs
DOUBT = 2.0  # weight of unknown instances added to every pattern
NEAR = 60  # characters read first around a place, and of a pattern that is kept as text
SHORTEST = 6  # characters of an identifier-like token

# Fixed formats.
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_NOT_SPACE = re.compile(r"\S*")
_MARK = re.compile(r"[0-9]+|@")
_WORD = re.compile(r"\w+")
_PLAIN = frozenset("0A+().-/,;:!?")  # of the shape of a group that may have others beside it
_OPENING, _CLOSING = frozenset("[{<\"'"), frozenset(".,;:!?]}>\"'")


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        head = text[done:at]
        start = done + len(head.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        done = at + 1
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in string.digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed formats by kind, then start."""
    found = [("email", a, b) for a, b in _emails(text)]
    ips, cards, ip_done, card_done = [], [], 0, 0
    for run in _RUN.finditer(text):  # both formats start and end with whole runs of digits
        start, end = run.span()
        if start >= ip_done and text.startswith(".", end) and (match := _IP.match(text, start)):
            ip_done = match.end()
            if all(len(part) <= 3 and int(part) <= 255 for part in (p.lstrip("0") or "0" for p in match.group().split("."))):
                ips.append(("ip", start, ip_done))
        if start >= card_done and (match := _CARD.match(text, start)):
            card_done = match.end()
            if card_done - start >= 13:
                digits = _digits(match.group())
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    cards.append(("card", start, card_done))
    found += ips + cards
    for match in _PHONE.finditer(text):
        if 9 <= len(_digits(match.group())) <= 15:
            found.append(("phone", *match.span()))
    return found


_SHAPE = str.maketrans({**dict.fromkeys(string.ascii_lowercase, "a"), **dict.fromkeys(string.ascii_uppercase, "A"), **dict.fromkeys(string.digits, "0")})


def _shape(token: str) -> str:
    """Letters, capitals and digits as classes, runs shortened."""
    return re.sub(r"(.)\1+", r"\1+", token.translate(_SHAPE))


class Surroundings:
    """The two words before and after places of a text, whole whatever their length."""

    def __init__(self, text: str):
        self.text, self.words = text, None

    def _far(self) -> list[tuple[int, int]]:
        if self.words is None:  # once per text, so that long stretches without words are not read again and again
            self.words = [match.span() for match in _WORD.finditer(self.text)]
        return self.words

    def before(self, at: int) -> str:
        for start in (max(0, at - NEAR), max(0, at - 16 * NEAR)):
            found = [match.span() for match in _WORD.finditer(self.text, start, at)]
            if not start or len(found) > 2 or (len(found) == 2 and found[0][0] > start):
                return self._named(found[-2:])
        words = self._far()
        last = bisect_left(words, (at,))  # the words that start before the place
        return self._named([(a, min(b, at)) for a, b in words[max(0, last - 2) : last]])

    def after(self, at: int) -> str:
        size = len(self.text)
        for stop in (min(size, at + NEAR), min(size, at + 16 * NEAR)):
            found = [match.span() for match in _WORD.finditer(self.text, at, stop)]
            if stop == size or len(found) > 2 or (len(found) == 2 and found[1][1] < stop):
                return self._named(found[:2])
        words = self._far()
        first = bisect_right(words, at, key=lambda span: span[1])  # the words that end behind the place
        return self._named([(max(a, at), b) for a, b in words[first : first + 2]])

    def _named(self, spans: list[tuple[int, int]]) -> str:
        """The words, or a digest of long ones, which tells them apart as well."""
        words = " ".join(self.text[a:b] for a, b in spans).lower()
        return words if len(words) <= NEAR else "#" + hashlib.blake2b(words.encode(), digest_size=16).hexdigest()


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The token without the punctuation around it; brackets inside it stay."""
    opened, closed = text.count("(", a, b), text.count(")", a, b)
    while b > a and (text[b - 1] in _CLOSING or (not opened and text[b - 1] == ")")):
        b -= 1
    while a < b and (text[a] in _OPENING or (not closed and text[a] == "(")):
        a += 1
    return (a + 1, b - 1) if opened == closed == 1 and text[a : a + 1] == "(" and text[b - 1] == ")" else (a, b)


def _tokens(text: str):
    """Start and end of every run without white space that has a digit or an @."""
    done = 0
    for mark in _MARK.finditer(text):
        if mark.start() >= done:
            a = mark.start()
            while a > done and not text[a - 1].isspace():
                a -= 1
            done = _NOT_SPACE.match(text, mark.end()).end()
            yield a, done


def instances(text: str, base: list[tuple[str, int, int]]):
    """(kind or None, start, end) of seeds and identifier-like tokens."""
    taken = sorted((a, b) for _, a, b in base)
    for kind, a, b in base:
        yield kind, a, b
    nearest = 0
    groups: list[list] = []  # start, end, whether the next group may belong to it
    for a, b in _tokens(text):
        while nearest < len(taken) and taken[nearest][1] <= a:
            nearest += 1
        if nearest < len(taken) and taken[nearest][0] < b:
            continue
        plain = _PLAIN.issuperset(_shape(text[a:b]))
        if plain and groups and groups[-1][2] and a == groups[-1][1] + 1 and text[a - 1] == " ":
            groups[-1][1] = b
        else:
            groups.append([a, b, plain])
        groups[-1][2] = plain and text[b - 1] not in _CLOSING
    for a, b, _ in groups:
        a, b = _trimmed(text, a, b)
        if b - a >= SHORTEST:
            yield None, a, b


FOUND = (
    "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "seen array<struct<kind:string,start:int,stop:int,instance:string,left_pattern:string,right_pattern:string>>"
)


def _find(batch: pa.RecordBatch):
    rows = {name: [] for name in ("base_sha256", "base", "seen", *(f"n_{kind}" for kind in KINDS))}
    for value in batch["text"]:
        text = value.as_py()
        base = base_spans(text)
        for kind in KINDS:
            rows[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
        spans = listed(base)
        rows["base"].append(spans)
        rows["base_sha256"].append(hashlib.sha256(spans.encode()).hexdigest())
        seen, around = [], Surroundings(text)
        for kind, a, b in instances(text, base):
            seen.append({
                "kind": kind, "start": a, "stop": b, "instance": hashlib.blake2b(text[a:b].encode(), digest_size=12).hexdigest(),
                "left_pattern": f"<{around.before(a)}", "right_pattern": f">{around.after(b)}",
            })
        rows["seen"].append(seen)
    yield rows | {"doc_id": batch["doc_id"], "text_key": batch["text_key"]}


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence, seeds) of the graph `edges` (pattern, instance, kind or null).

    A seed belongs to its kind for good. Tables are written between rounds, so a round that loses an
    executor starts from files."""
    seeds = edges.where("kind is not null")
    members = seeds.groupBy("pattern", "kind").agg(F.countDistinct("instance").alias("seeds"))
    sizes = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("size"))
    base = cut_lineage(members.join(sizes, "pattern"))  # patterns without a seed never score
    unknown = cut_lineage(
        edges.where("kind is null").select("pattern", "instance").distinct().join(base.select("pattern").distinct(), "pattern")
    )
    confidence = lambda weight: weight / (F.col("size") + F.lit(DOUBT))
    scored = base.withColumn("confidence", confidence(F.col("seeds")))
    for _ in range(rounds - 1):
        own = F.log1p(-F.least("confidence", F.lit(0.999)))
        votes = unknown.join(scored.select("pattern", "kind", own.alias("own")), "pattern")
        totals = votes.groupBy("instance", "kind").agg(F.sum("own").alias("total"))
        others = F.greatest(1 - F.exp(F.col("total") - F.col("own")), F.lit(0.0))  # without the pattern's own vote
        gained = votes.join(totals, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum(others).alias("gained"))
        scored = cut_lineage(
            base.join(gained, ["pattern", "kind"], "left")
            .withColumn("confidence", confidence(F.col("seeds") + F.coalesce("gained", F.lit(0.0)))).drop("gained")
        )
    return scored.select("pattern", "kind", "confidence", "seeds")


def extract(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_<kind>, base_sha256, spans, n_added."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    found = cut_lineage(map_rows(rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), _find, FOUND))
    seen = found.select("doc_id", "text_key", F.explode("seen").alias("s")).select("doc_id", "text_key", "s.*")
    both = F.explode(F.array("left_pattern", "right_pattern")).alias("pattern")
    lexical = F.length("pattern") > 1  # a text that starts or ends there has no words to tell
    edges = cut_lineage(seen.select(both, "instance", "kind").where(lexical).distinct())
    good = cut_lineage(score_patterns(edges).where((F.col("confidence") >= CONFIDENCE) & (F.col("seeds") >= SUPPORT)))
    unseen = seen.where("kind is null").select("doc_id", "text_key", "start", "stop", both)
    marked = unseen.join(good.select("pattern", F.col("kind").alias("as_kind"), "confidence"), "pattern")
    order = F.struct(F.col("confidence"), F.col("as_kind"))
    best = marked.groupBy("doc_id", "text_key", "start", "stop").agg(F.max(order).alias("best"))
    span = F.struct(F.col("best.as_kind").alias("kind"), "start", "stop")
    added = best.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(span)).alias("added"))  # of one document
    added = added.withColumnsRenamed({"doc_id": "at_id", "text_key": "at_key"})
    joined = found.drop("seen").join(
        added, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_key")), "left"
    )
    return map_rows(
        joined.select("doc_id", *[f"n_{kind}" for kind in KINDS], "base_sha256", "base", "added"), _with_added,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
    )


def _with_added(batch: pa.RecordBatch):
    spans, counts = [], []
    for base, added in zip(batch["base"].to_pylist(), batch["added"].to_pylist(), strict=True):
        if added:
            every = [(k, int(a), int(b)) for k, a, b in (span.split(":") for span in base.split(",") if span)]
            every += [(x["kind"], x["start"], x["stop"]) for x in added]
            base = listed(sorted(every, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))
        spans.append(base)
        counts.append(len(added or ()))
    yield {name: batch[name] for name in ("doc_id", "base_sha256", *(f"n_{kind}" for kind in KINDS))} | {"spans": spans, "n_added": counts}
