"""Secret scan: fixed formats, and a character network over every candidate with its surroundings.

Candidates are the findings of three fixed formats (assign, access, hex) and every other token
of eight or more letters, digits and joining signs that has a digit. The network reads ROOM of the candidate's bytes and the
bytes around them; a longer candidate is read in stretches that overlap by half, and its score is the highest of them. It is
trained on labelled findings: those of the formats against other candidates, all that are distinct by the candidate and the 16
characters before it. Three in four fit the network: they are dealt by hash to shards, each shard goes on from the common
weights and moments for an epoch, and these are averaged by the shards' sizes. The others are scored and counted by label and logit, in
steps of 1 / STEPS; the steps' middles calibrate the network and their lower ends give the threshold, the highest that keeps the wanted recall
on them. Training reads at most STRETCHES of a finding, spread over it; all of them score as high or higher, so the
recall stays. Candidates above the threshold are added as kind `net`; the fixed spans stay. Every candidate of every whole text is scored.

So that the network learns more than the formats' own words, half of the positives are shown without
their surroundings.

Defined cases: null text is empty; without positive or negative findings nothing is trained and nothing
added; rows that repeat are scanned one by one; extra columns are not read.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.nets import CharNet, recall_threshold
from panelwright.llm.words import listed, map_rows
from panelwright.session import cut_lineage

KINDS = ("assign", "access", "hex")
SHARD = 3_000  # findings that one task fits at a time
EPOCHS = 6  # over all findings; after each, the shards' states are averaged
STEPS = 1_024  # steps of a logit at which findings are counted for the calibration
RECALL = 0.98
CONTEXT = 24  # bytes on either side of a candidate
WIDTH = 96
ROOM = WIDTH - 2 * CONTEXT
STRETCHES = 16

# Fixed formats; letters of the names in either case, A-Z only.
_ASSIGN = re.compile(
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[0-9]+")
_REST = re.compile(r"[A-Za-z0-9+/_=-]*")
_INSIDE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
SHORTEST = 8  # characters of other candidates


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed formats by start, then kind."""
    lowered = text.lower()  # tells only whether a name can occur
    named = any(name in lowered for name in _NAMES)
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 6] if named else []
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def other_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit outside the fixed spans."""
    found, nearest = [], 0
    taken = sorted((a, b) for _, a, b in base)
    furthest = [0]
    for _, b in taken:
        furthest.append(max(furthest[-1], b))
    done = 0
    for run in _RUN.finditer(text):
        if run.start() < done:
            continue
        a = run.start()
        while a > done and text[a - 1] in _INSIDE:
            a -= 1
        b = done = _REST.match(text, run.end()).end()
        if b - a < SHORTEST:
            continue
        while nearest < len(taken) and taken[nearest][0] < b:
            nearest += 1
        if furthest[nearest] <= a:
            found.append((a, b))
    return found


def windows(text: str, start: int, end: int, alone: bool = False, most: int | None = None):
    """Blocks of rows, one for each stretch of the candidate (or `most` of them, spread over it): its bytes, each plus 256, between
    the bytes around it; zero where there is none."""
    inner = text[start:end].encode("utf-8", "replace")
    left = b"" if alone else text[max(0, start - CONTEXT) : start].encode("utf-8", "replace")[-CONTEXT:]
    right = b"" if alone else text[end : end + CONTEXT].encode("utf-8", "replace")[:CONTEXT]
    data = np.frombuffer(left.rjust(CONTEXT, b"\0") + inner.ljust(ROOM, b"\0") + right.ljust(CONTEXT, b"\0"), dtype=np.uint8)
    last = len(data) - WIDTH
    starts = np.append(np.arange(0, last, ROOM // 2), last)
    if most is not None and len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).astype(int)]
    for at in range(0, len(starts), 2_048):
        codes = data[starts[at : at + 2_048, None] + np.arange(WIDTH)].astype(np.int16)
        middle = codes[:, CONTEXT : CONTEXT + ROOM]
        middle[middle > 0] += 256
        yield codes


def _labelled(batch: pa.RecordBatch):
    rows: dict[str, list] = {"label": [], "rank": [], "codes": []}
    for value in batch["text"]:
        text = value.as_py()
        base = base_spans(text)
        spans = [(1, a, b) for _, a, b in base] + [(0, a, b) for a, b in other_candidates(text, base)]
        for label, a, b in spans:
            rank = int.from_bytes(hashlib.blake2b(text[max(0, a - 16) : b].encode("utf-8", "replace"), digest_size=7).digest(), "little")
            rows["label"].append(label)
            rows["rank"].append(rank)
            rows["codes"].append(b"".join(codes.tobytes() for codes in windows(text, a, b, alone=bool(label and rank % 2), most=STRETCHES)))
    yield rows


def _finding_codes(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(codes, dtype=np.int16).reshape(-1, WIDTH) for codes in table["codes"].to_pylist()]


def _shard_fit(state: np.ndarray, done: int, share: float):
    """A function that goes on from the state for one more epoch over a shard's findings, whatever their order."""

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("rank", "ascending")])
        net, codes = CharNet(WIDTH), _finding_codes(table)
        net.load(state)
        labels = np.repeat(table["label"].to_numpy(), [len(block) for block in codes])
        net.fit(np.concatenate(codes), labels, epochs=1, share=share, done=done)
        after = np.clip(np.nan_to_num(net.vector().astype(np.float64)), -1e3, 1e3)
        return pa.table({"rows": pa.array([len(labels)], pa.int64()), "state": pa.array([after], pa.list_(pa.float64()))})

    return fit


def _fitted(findings: DataFrame) -> CharNet:
    """The network over every finding: in each epoch all shards go on from the same state, and their states are averaged."""
    stretches = F.length("codes") / (2 * WIDTH)
    size, share, rows = findings.agg(
        F.count("*"), F.coalesce(F.sum(stretches * F.col("label")) / F.sum(stretches), F.lit(0.0)), F.coalesce(F.sum(stretches), F.lit(0.0))
    ).first()
    shards = max(1, -(-size // SHARD))
    dealt = findings.withColumn("shard", F.pmod(F.shiftright("rank", 3), F.lit(shards))).repartition(shards, "shard")
    net = CharNet(WIDTH)
    for done in range(EPOCHS):
        made = dealt.groupBy("shard").applyInArrow(_shard_fit(net.vector(), done, share), "rows long, state array<double>")
        # Decimals, so that the sum does not depend on its order.
        part = (F.col("rows") * F.col("value")).cast("decimal(28,18)")
        sums = made.select("rows", F.posexplode("state").alias("at", "value")).groupBy("at").agg(F.sum(part).alias("sum"))
        net.load(np.array([float(row.sum) for row in sums.orderBy("at").collect()]) / rows)  # one row per weight
    return net


def train(rows: DataFrame) -> tuple[CharNet, float] | None:
    """The network and its threshold from all distinct findings; three in four fit it, the others calibrate it."""
    found = map_rows(rows.select("text"), _labelled, "label int, rank long, codes binary")
    findings = cut_lineage(found.groupBy("label", "rank").agg(F.min("codes").alias("codes")))
    held = F.pmod(F.shiftright("rank", 1), F.lit(4)) == 0
    parts = {(row.label, row.held) for row in findings.select("label", held.alias("held")).distinct().collect()}
    if {label for label, _ in parts} != {0, 1}:
        return None
    fitted, checked = (findings.where(~held), findings.where(held)) if len(parts) == 4 else (findings, findings)
    net = _fitted(fitted)

    def scored(batch: pa.RecordBatch):
        codes = _finding_codes(batch)
        yield {"label": batch["label"], "step": [int(np.floor(net.logits(block).max() * STEPS)) for block in codes]}

    counted = map_rows(checked.select("label", "codes"), scored, "label int, step long").groupBy("step", "label").count()
    table = counted.orderBy("step", "label").collect()  # the logits' range, not the findings
    logits, labels, counts = (np.array(column, dtype=np.float64) for column in zip(*((r.step / STEPS, r.label, r["count"]) for r in table), strict=True))
    net.calibrate_logits(logits + 0.5 / STEPS, labels, counts)
    return net, recall_threshold(1 / (1 + np.exp(-(net.slope * logits + net.offset))), labels, RECALL, counts)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, max_score double"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_<kind>, base_sha256, spans, n_added, and the highest probability."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    model = rows.sparkSession.sparkContext.broadcast(train(rows))  # some thousand numbers

    def run(batch: pa.RecordBatch):
        net, threshold = model.value or (None, 1.0)
        texts = [value.as_py() for value in batch["text"]]
        bases = [base_spans(text) for text in texts]
        owner, spans, codes, held = [], [], [], []  # of `codes`, the number of the span
        scores: list[float] = []
        waiting = 0

        def flush():
            if codes and net is not None:
                numbers = np.repeat(held, [len(block) for block in codes])
                for number, score in zip(numbers.tolist(), net.probability(np.concatenate(codes)).tolist(), strict=True):
                    scores[number] = max(scores[number], score)
            codes.clear()
            held.clear()

        for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
            for kind, a, b in [*base, *(("net", a, b) for a, b in other_candidates(text, base))]:
                owner.append(i)
                spans.append((kind, a, b))
                scores.append(0.0)
                for block in windows(text, a, b):
                    held.append(len(spans) - 1)
                    codes.append(block)
                    waiting += len(block)
                    if waiting >= 2_048:
                        flush()
                        waiting = 0
        flush()
        added: list[list] = [[] for _ in texts]
        best: list[float | None] = [None] * len(texts)
        for i, span, score in zip(owner, spans, scores, strict=True):
            best[i] = score if best[i] is None else max(best[i], score)
            if span[0] == "net" and score >= threshold:
                added[i].append(span)
        order = {kind: i for i, kind in enumerate((*KINDS, "net"))}
        every = [sorted(base + more, key=lambda x: (x[1], order[x[0]])) for base, more in zip(bases, added, strict=True)]
        yield {f"n_{kind}": [sum(k == kind for k, _, _ in base) for base in bases] for kind in KINDS} | {
            "doc_id": batch["doc_id"], "base_sha256": [hashlib.sha256(listed(base).encode()).hexdigest() for base in bases],
            "spans": [listed(x) for x in every], "n_added": [len(x) for x in added], "max_score": best,
        }

    return map_rows(rows, run, SCHEMA)
