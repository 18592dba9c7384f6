"""Language identification by interpolated Kneser-Ney models of characters, one for each language.

Letters are folded to lower case, everything else parts words as one blank, and four characters make an expression. A language's model
discounts the counts of its expressions (a discount for each order, from how many occur once and twice) and gives what that saves to the model
one order lower, which counts in how many contexts a character follows, down to single characters and to one share for all characters.
Counts cover every text that may teach, whole: they are reduced in the tasks and summed by Spark, and the models are grouped aggregates and
joins of the counts. The models of all languages lie in arrays sorted by a hash of the expression (a bijective one, so nothing collides), with
a directory of the hash's upper bits; tasks look up the distinct expressions of a run of text and add them up for its texts. The language with the
lowest cross-entropy for each character wins.

The arrays go to the tasks in slices of at most `entries` numbers, one pass over the texts for each slice (four languages with Latin letters need
one); a text's sums over the slices are added. Score and rejection are calibrated on an eighth of the teaching texts (all of it),
scored by models of the other seven; the models in use count all of them. The score is the winner's share if likelihoods are flattened
by the temperature that fits these texts best. A text is rejected if its cross-entropy is too high for the language: farther above the mean of
the language's texts among these, in terms of the spread at its length, than all but `reject` of these.

Defined cases: null texts and texts without a letter are `und` with score 0, as is everything if no text teaches; a null id is never held out and
does not teach; ties go to the language that sorts first; letters beyond the basic plane share codes; repeated rows teach each time and get
the same answer; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans.quantiles import quantiles_of
from ..session import cut_lineage
from . import arrays as A
from .preference_quality import fold_of
from .tables import keyed, named_id
from .units import text_chunks

U = np.uint64
ORDER = 4
BLANK = 32
UNKNOWN = "und"
ENTRIES = 8 << 20
ASIDE = 8
#: where too little occurs once or twice to tell
DISCOUNT = 0.75
REJECT = 0.005
#: characters that are looked up at once, and expressions that a counting task holds
BLOCK, HELD = 1 << 20, 1 << 20
#: pairs of characters are dealt to slices by this remainder
DEAL = 1_000_003


@lru_cache(1)
def letters() -> np.ndarray:
    """Code point to folded 16-bit code; a blank for what is no letter."""
    out = np.full(0x110000, BLANK, np.uint16)
    for i in (i for i in range(0x110000) if chr(i).isalpha()):
        low = ord(chr(i).lower()[0])
        out[i] = low if low < 1 << 16 else 0xE000 + low % 0x1900
    return out


class Text:
    """Folded characters of some texts, each with three blanks before it and one behind; `first` is where each one's own begin (rows + 1)."""

    def __init__(self, text: pa.Array):
        self.many = np.zeros(len(text), np.int64)
        self.x = np.full((ORDER - 1) * len(text), BLANK, np.uint16)
        if not len(text):
            return
        buf, off = A.column_bytes(pc.binary_join_element_wise(*(pa.scalar(v, pa.large_string()) if isinstance(v, str) else v for v in (text.fill_null(""), "", " "))))
        try:
            point = np.frombuffer(bytes(buf).decode().encode("utf-32-le"), "<u4")
            start = np.concatenate([[0], np.cumsum(np.add.reduceat((buf & 0xC0) != 0x80, off[:-1], dtype=np.int64))])
        except UnicodeDecodeError:  # broken bytes part words
            rows = [bytes(buf[a:b]).decode(errors="replace") for a, b in zip(off[:-1], off[1:])]
            point = np.frombuffer("".join(rows).encode("utf-32-le"), "<u4")
            start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        code = letters()[point]
        blank = code == BLANK
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        keep[start[:-1]] = ~blank[start[:-1]]
        self.many = np.add.reduceat(keep, start[:-1], dtype=np.int64)
        kept = code[keep]
        self.x = np.full(len(kept) + (ORDER - 1) * len(text), BLANK, np.uint16)
        self.x[np.arange(len(kept)) + (ORDER - 1) * (self.row(0, len(kept)) + 1)] = kept

    def row(self, a: int, b: int) -> np.ndarray:
        """Which text the characters a to b - 1 belong to, blanks before texts not counted."""
        ends = np.cumsum(self.many)
        return np.repeat(np.arange(len(ends)), np.maximum(np.minimum(ends, b) - np.maximum(ends - self.many, a), 0))

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Text and expression (the character and the three before it) of each character, BLOCK at a time."""
        total = int(self.many.sum())
        for a in range(0, total, BLOCK):
            row = self.row(a, min(total, a + BLOCK))
            at = np.arange(a, a + len(row)) + (ORDER - 1) * (row + 1)
            code = np.zeros(len(row), U)
            for k in range(ORDER):
                code = (code << U(16)) | self.x[at - (ORDER - 1 - k)].astype(U)
            yield row, code


def _sum(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(code, return_inverse=True)
    return distinct, np.bincount(at, weights=n, minlength=len(distinct)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's expressions by language and part."""
    held: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

    def reduced() -> int:
        for k, v in held.items():
            held[k] = [_sum(np.concatenate([x[0] for x in v]), np.concatenate([x[1] for x in v]))]
        return sum(len(v[0][0]) for v in held.values())

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, aside), v in held.items():
            for code, n in v:
                for i in range(0, len(code), 1 << 16):
                    c = code[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([aside] * len(c)), pa.array(c.view(np.int64)), pa.array(n[i:i + len(c)])], ["lang", "aside", "gram", "c"])
        held.clear()
    waiting = 0
    for batch, text in text_chunks(batches):
        kinds = list(zip(batch.column("lang").to_pylist(), batch.column("aside").to_pylist()))
        place = {k: i for i, k in enumerate(dict.fromkeys(kinds))}
        kind = np.array([place[k] for k in kinds], np.int64)
        for row, code in Text(text).blocks():
            of = kind[row]
            for k, i in place.items():
                mine = code[of == i]
                if len(mine):
                    held.setdefault(k, []).append(np.unique(mine, return_counts=True))
                    waiting += len(held[k][-1][0])
        if waiting > 2 * HELD:
            waiting = reduced()
            if waiting > HELD:
                yield from rows()
                waiting = 0
    reduced()
    yield from rows()


def models(counts: DataFrame) -> DataFrame:
    """whole, code, lang, logp (of the expression) and logb (what its language leaves to the order below after it), of all orders.

    From lang, aside, gram, c: the models of all texts (whole), and those without the texts set aside."""
    both = counts.select("lang", "gram", "c", F.explode(F.when(F.col("aside"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))).alias("whole"))
    of = ["whole", "lang"]
    low = lambda k: F.col("gram").bitwiseAND((1 << 16 * k) - 1)
    levels = {ORDER: cut_lineage(both.groupBy(*of, "gram").agg(F.sum("c").alias("c")))}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy(*of, low(k).alias("gram")).agg(F.count("*").alias("c"))
    # all orders in one table: few plans, which the driver keeps in memory
    g = cut_lineage(reduce(DataFrame.unionByName, [levels[k].select(F.lit(k).alias("k"), *of, "gram", F.shiftrightunsigned("gram", 16).alias("context"), "c") for k in levels]))
    chars = g.filter("k = 1").select("gram").distinct().count()
    ones = lambda n: F.sum((F.col("c") == n).cast("double"))
    saved = g.groupBy("k", *of).agg(ones(1).alias("n1"), ones(2).alias("n2"))  # a row for each language and order
    saved = saved.select("k", *of, F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(DISCOUNT).alias("d"))
    context = g.groupBy("k", *of, "context").agg(F.sum("c").alias("total"), F.count("*").alias("types")).join(F.broadcast(saved), ["k", *of])
    context = context.select("k", *of, "context", "total", "d", (F.col("d") * F.col("types") / F.col("total")).alias("back"))
    own = cut_lineage(g.join(context, ["k", *of, "context"]).select("k", *of, "gram", "context", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), "back"))
    none, first = F.lit(None).cast("double"), F.lit(-float(np.log(chars + 1)))
    parts = [own.select(*of, F.col("context").alias("code"), none.alias("logp"), F.log("back").alias("logb")), own.filter("k = 1").select(*of, F.lit(0).cast("long").alias("code"), first.alias("logp"), none.alias("logb"))]
    below = None
    for k in range(1, ORDER + 1):
        mine = own.filter(F.col("k") == k).withColumn("short", low(k - 1))
        mine = mine.withColumn("less", first) if below is None else mine.join(below, [*of, "short"])
        p = mine.select(*of, "gram", F.log(F.col("own") + F.col("back") * F.exp("less")).alias("logp"))
        below = p.select(*of, F.col("gram").alias("short"), F.col("logp").alias("less"))
        parts.append(p.select(*of, F.col("gram").alias("code"), "logp", none.alias("logb")))
    return cut_lineage(reduce(DataFrame.unionByName, parts).groupBy(*of, "code").agg(F.max("logp").alias("logp"), F.max("logb").alias("logb")))


def _slice_of(pair, slices: int):
    return F.pmod(pair, F.lit(DEAL)) % slices


def in_slice(table: DataFrame, names: list[str], slices: int, k: int) -> Lookup:
    """The part of the models that expressions need whose middle two characters belong to slice k. Orders one and two are in every slice."""
    code, pair = F.col("code"), (1 << 32) - 1
    before, last = _slice_of(F.shiftrightunsigned(code, 16).bitwiseAND(pair), slices) == k, _slice_of(code.bitwiseAND(pair), slices) == k
    short = (code >= 0) & (code <= pair)
    three = (code > pair) & (code < 1 << 48)
    rows = table.filter(short | before | (three & last)) if slices > 1 else table
    lang = (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")) - 1).cast("int").alias("lang")
    got = rows.select("code", lang, F.col("logp").cast("float"), F.col("logb").cast("float")).toArrow()  # about `entries` numbers
    distinct, at = np.unique(got["code"].to_numpy().view(U), return_inverse=True)
    lang = got["lang"].to_numpy()
    logp, logb = np.full((len(distinct), len(names)), np.nan, np.float32), np.zeros((len(distinct), len(names)), np.float32)
    logp[at, lang] = pc.fill_null(got["logp"], float("nan")).to_numpy()
    logb[at, lang] = pc.fill_null(got["logb"], 0.0).to_numpy()
    return Lookup(distinct, logp, logb, slices, k)


class Lookup:
    """Arrays sorted by the hash of the expression, with a directory of the hash's upper bits; a column for each language."""

    def __init__(self, code: np.ndarray, logp: np.ndarray, logb: np.ndarray, slices: int, k: int):
        key = A.mix(code)
        order = np.argsort(key)
        self.key, self.logp, self.logb, self.slices, self.k = key[order], logp[order], logb[order], slices, k
        bits = int(np.ceil(np.log2(len(code) + 2)))
        self.shift = U(64 - bits)
        self.directory = np.searchsorted(self.key, np.arange(1 << bits, dtype=U) << self.shift)
        self.longest = int(np.diff(np.append(self.directory, len(code))).max(initial=0))

    def find(self, code: np.ndarray) -> np.ndarray:
        """Places; -1 for what no language has."""
        key = A.mix(code)
        at = self.directory[(key >> self.shift).astype(np.int64)]
        out = np.full(len(code), -1)
        for step in range(self.longest):
            here = np.minimum(at + step, len(self.key) - 1)
            out = np.where(self.key[here] == key, here, out)
        return out

    def log_likelihoods(self, code: np.ndarray) -> np.ndarray:
        """Expressions by languages."""
        now = np.repeat(self.logp[self.find(np.zeros(1, U))], len(code), axis=0)
        for k in range(1, ORDER + 1):
            gram = code & U((1 << 16 * k) - 1)
            at, context = self.find(gram), self.find(gram >> U(16))
            p = np.where((at >= 0)[:, None], self.logp[at], np.nan)
            b = np.where((context >= 0)[:, None], self.logb[context], 0)
            now = np.where(np.isnan(p), now + b, p)
        return now

    def sums(self, text: Text) -> np.ndarray:
        """Log-likelihood of each text in each language, as far as this slice has it."""
        out = np.zeros((len(text.many), self.logp.shape[1]))
        for row, code in text.blocks():
            if self.slices > 1:
                mine = (code >> U(16) & U((1 << 32) - 1)) % U(DEAL) % U(self.slices) == self.k
                row, code = row[mine], code[mine]
            distinct, at = np.unique(code, return_inverse=True)
            like = self.log_likelihoods(distinct)
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(row, weights=like[at, j], minlength=len(out))
        return out


class Verdicts:
    """Language, score and rejection from cross-entropies."""

    def __init__(self, names: list[str], temperature: float = 1.0, power: float = 1.0):
        self.names, self.temperature, self.power = names, temperature, power
        self.usual: np.ndarray | None = None
        self.limit = np.inf

    def shares(self, n: np.ndarray, entropy: np.ndarray) -> np.ndarray:
        """Log shares of the languages."""
        x = -self.temperature * np.maximum(n, 1)[:, None] ** self.power * entropy
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    def excess(self, n: np.ndarray, own: np.ndarray, best: np.ndarray) -> np.ndarray:
        mean, a, b = self.usual[best].T
        return (own - mean) / np.sqrt(a + b / np.maximum(n, 1))

    def batch(self, key: pa.Array, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        entropy = -sums / np.maximum(n, 1)[:, None]
        best = np.argmin(entropy, axis=1)
        rows, some = np.arange(len(n)), n > 0
        score = np.where(some, np.exp(self.shares(n, entropy)[rows, best]), 0.0)
        own = entropy[rows, best]
        strange = ~some | (self.excess(n, own, best) > self.limit if self.usual is not None else False)
        lang = np.where(some, np.array(self.names, object)[best], UNKNOWN)
        return pa.RecordBatch.from_arrays([key, pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(own, mask=~some), pa.array(strange)], ["key", "lang_pred", "score", "cross_entropy", "rejected"])


#: powers of the length and temperatures that are tried
FLATTEN = [(power, float(t)) for power in (0.25, 0.5, 0.75, 1.0) for t in 2.0 ** np.arange(-8, 9, 0.5)]


def calibrated(got: DataFrame, names: list[str], reject: float) -> Verdicts | None:
    """Verdicts by all rows of lang, n and sums (n above 0; None without rows): temperature by likelihood of the labels; the usual
    cross-entropy and its spread by length; the limit of what is usual. Only sums for each language or temperature come to the driver."""
    verdicts = Verdicts(names)
    place = {x: i for i, x in enumerate(names)}

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(FLATTEN))
        for b in batches:
            if b.num_rows:
                n = b.column("n").to_numpy().astype(float)
                entropy = -b.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1) / n[:, None]
                label = np.array([place[x] for x in b.column("lang").to_pylist()])
                loss -= [Verdicts(names, t, power).shares(n, entropy)[np.arange(len(n)), label].sum() for power, t in FLATTEN]
        if loss.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(loss), dtype=np.int32)), pa.array(loss)], ["i", "loss"])

    at = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")).cast("int")
    of = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("at"))
    rows = got.select(at.alias("at"), F.col("n").cast("double").alias("n"), (-F.element_at("sums", at) / F.col("n")).alias("own"))
    root = F.sqrt("n")
    each = {r["at"] - 1: r for r in rows.groupBy("at").agg(F.count("*").alias("rows"), (F.sum(root * F.col("own")) / F.sum(root)).alias("mean"), F.avg("own").alias("plain"), F.var_pop("own").alias("var")).collect()}
    total = sum(r["rows"] for r in each.values())
    if not total:
        return None
    best = None
    loss = {r["i"]: r["loss"] for r in got.mapInArrow(losses, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).collect()}
    for i, (power, t) in enumerate(FLATTEN):
        mean = loss.get(i, 0.0) / total
        if best is None or mean < best - 1e-12:
            best, verdicts.power, verdicts.temperature = mean, power, t
    plain = sum(r["rows"] * r["plain"] for r in each.values()) / total
    every = plain, max(sum(r["rows"] * (r["var"] + (r["plain"] - plain) ** 2) for r in each.values()) / total, 1e-6), 0.0
    mean = [each[j]["mean"] if j in each else 0.0 for j in range(len(names))]
    spread = rows.withColumns({"square": F.pow(F.col("own") - of(mean), F.lit(2.0)), "x": 1 / F.col("n")}).groupBy("at").agg(
        F.avg("square").alias("square"), F.avg("x").alias("x"), F.covar_pop("x", "square").alias("both"), F.var_pop("x").alias("var"), (F.max("x") > F.min("x")).alias("differ")).collect()
    usual = [every] * len(names)
    for r in spread:
        j = r["at"] - 1
        if each[j]["rows"] >= 20:
            b = max(0.0, r["both"] / r["var"]) if r["differ"] and r["var"] else 0.0
            usual[j] = mean[j], max(r["square"] - b * r["x"], 1e-6), b
    verdicts.usual = np.array(usual)
    middle, a, b = (of(v) for v in verdicts.usual.T)
    _, limits = quantiles_of(rows, [(F.col("own") - middle) / F.sqrt(a + b / F.col("n"))], [1 - reject])
    verdicts.limit = limits[0][0]
    return verdicts


JUDGED = "key long, lang_pred string, score double, cross_entropy double, rejected boolean"


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def measured(texts: DataFrame, table: DataFrame, names: list[str], entries: int, verdicts: Verdicts | None = None) -> DataFrame:
    """key, n and sums (log-likelihoods by language) of every row of texts (key, text and others, which stay), or what the verdicts make of them."""
    spark = texts.sparkSession
    slices = max(1, -(-table.count() * 2 // entries))
    more = [c for c in texts.columns if c not in ("key", "text")]
    kinds = dict(texts.dtypes)
    if slices > 1:  # equal rows have equal sums: told by two hashes of the text, counted and dealt out again
        texts = texts.withColumns({"one": F.xxhash64("text"), "two": F.xxhash64(F.lit(1), "text")})
        kinds, more = dict(texts.dtypes), [*more, "one", "two"]
    found = []
    for k in range(slices):
        shared = spark.sparkContext.broadcast(in_slice(table, names, slices, k))

        def job(batches, shared=shared, judge=verdicts if slices == 1 else None):
            for batch, text in text_chunks(batches):
                t = Text(text)
                sums = shared.value.sums(t)
                yield judge.batch(batch.column("key"), t.many, sums) if judge else pa.RecordBatch.from_arrays([batch.column("key"), *(batch.column(c) for c in more), pa.array(t.many), _lists(sums)], ["key", *more, "n", "sums"])
        out = texts.mapInArrow(job, JUDGED if verdicts and slices == 1 else ", ".join(["key long", *(f"{c} {kinds[c]}" for c in more), "n long", "sums array<double>"]))
        found.append(cut_lineage(out) if slices > 1 else out)
    if slices == 1:
        return found[0]
    by = reduce(DataFrame.unionByName, found).groupBy("key", *more, "n")
    each = by.agg(F.count("*").alias("rows"), F.array(*[F.sum(F.col("sums")[j]) for j in range(len(names))]).alias("all"))
    one = each.select("*", F.explode(F.sequence(F.lit(1), (F.col("rows") / slices).cast("int")))).select("key", *more[:-2], "n", F.transform("all", lambda v: v * slices / F.col("rows")).alias("sums"))

    def judged(batches):
        for b in batches:
            if b.num_rows:
                yield verdicts.batch(b.column("key"), b.column("n").to_numpy(), b.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
    return one.select("key", "n", "sums").mapInArrow(judged, JUDGED) if verdicts else one


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1,
                entries: int = ENTRIES, reject: float = REJECT) -> DataFrame:
    """One row for each document: the id, held_out, lang_pred, score, cross_entropy (nats for each character) and rejected."""
    base = keyed(docs, id_col, text_col, carry=[lang_col])
    lang = F.col("rest")[lang_col].cast("string")
    taught = base.filter(F.coalesce(fold_of("key", folds) != held, F.lit(False)) & named_id().isNotNull() & lang.isNotNull() & F.col("text").isNotNull())
    taught = taught.select("key", lang.alias("lang"), (F.pmod(F.xxhash64("text"), F.lit(ASIDE)) == 0).alias("aside"), "text")
    counts = cut_lineage(taught.select("lang", "aside", "text").mapInArrow(_count, "lang string, aside boolean, gram long, c long").groupBy("lang", "aside", "gram").agg(F.sum("c").alias("c")))
    have = counts.groupBy("lang").agg(F.bool_or(~F.col("aside")).alias("most"), F.sum(F.col("aside").cast("long")).alias("some")).collect()  # a row for each language
    names = sorted(r["lang"] for r in have)
    held_out = F.coalesce(fold_of("key", folds) == held, F.lit(False)) & named_id().isNotNull()
    if names:
        verdicts, tables = Verdicts(names), models(counts)
        part = sorted(r["lang"] for r in have if r["most"])
        if part and any(r["some"] for r in have):
            rest = taught.filter("aside").filter(F.col("lang").isin(part))
            got = measured(rest.select("key", "lang", "text"), tables.filter("NOT whole"), part, entries).filter("n > 0").select("lang", "n", "sums")
            inner = calibrated(cut_lineage(got), part, reject)
            if inner:
                verdicts.temperature, verdicts.power, verdicts.limit = inner.temperature, inner.power, inner.limit
                every = inner.usual.mean(axis=0)
                verdicts.usual = np.array([inner.usual[part.index(x)] if x in part else every for x in names])
        out = measured(base.select("key", "text"), tables.filter("whole"), names, entries, verdicts)
    else:
        out = base.select("key", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    return out.select(named_id().alias(id_col), held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
