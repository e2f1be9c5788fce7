"""PII by bootstrapped contextual extraction.

Matches of strict rules are seed entities. The words around them become lexical patterns; over the whole corpus, a
bipartite graph of patterns and instances (seeds, and look-alikes that no rule accepts) is scored in rounds:
patterns by the instances they hold, instances by the patterns that hold them. Look-alikes that sure patterns
vouch for are new entities.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Rounds of the scoring, seeds of distinct content that a pattern needs, and the least score that counts as sure.
ROUNDS, LEAST_SEEDS, SURE = 3, 5, 0.9
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]\S*")
#: Further groups of digits after a token of digits, and an address that is spelled out.
_GROUPS = re.compile(r"(?:\x20[0-9()+./-]+)+")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:\x20at\x20|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]+(?:(?:\x20dot\x20|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]+)+")
_EDGE = "\"'`.,;:!?()[]{}<>*#$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What a leftmost search finds, in linear time: a name runs up to its @, so only the run before an @ counts."""
    end, at = 0, text.find("@")
    while at >= 0:
        run = _LOCAL.match(text[end:at][::-1])
        if run and (m := _DOMAIN.match(text, at + 1)):
            yield at - run.end(), m.end()
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)


def base(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strict rules, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def look_alike(token: str) -> str | None:
    """The kind that a token, or a row of groups of digits, might be."""
    digits = sum("0" <= c <= "9" for c in token)
    if "@" in token:
        return "email" if re.fullmatch(r"[^@\s]+@[^@\s]+", token) else None
    if re.fullmatch(r"[0-9]{1,3}(?:[.,:][0-9]{1,3}){3}", token):
        return "ip"
    if not re.fullmatch(r"[0-9()+./\x20-]+", token):
        return None
    return "card" if 13 <= digits <= 19 else "phone" if 7 <= digits <= 12 else None


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what might be an entity and overlaps none of the sorted spans taken: tokens, rows of groups of digits, spelled addresses."""
    starts = [a for a, _ in taken]
    most = [b for _, b in taken]
    for i in range(1, len(most)):
        most[i] = max(most[i], most[i - 1])
    clear = lambda s, e: (i := bisect_left(starts, e)) == 0 or most[i - 1] <= s
    done = 0
    for m in _MARK.finditer(text):
        s, e = m.span()
        if s < done:
            continue
        while s > done and not text[s - 1].isspace():
            s -= 1
        done = e
        raw = text[s:e]
        if not set(raw) - set("0123456789()+./-") and (more := _GROUPS.match(text, e)):
            end = more.start() + len(more[0].rstrip(_EDGE))
            if clear(s, end) and (k := look_alike(text[s:end])):
                done = more.end()
                yield k, s, end
                continue
        s, e = s + len(raw) - len(raw.lstrip(_EDGE)), e - (len(raw) - len(raw.rstrip(_EDGE)))
        if clear(s, e) and (k := look_alike(text[s:e])):
            yield k, s, e
    if "dot" in text:
        for m in _SPELLED.finditer(text):
            if clear(*m.span()):
                yield "email", *m.span()


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: the two words before it, and the word before with the word after."""
    before = [w.strip(_EDGE).lower() for w in text[max(0, start - 80) : start].split()[-2:]]
    after = [w.strip(_EDGE).lower() for w in text[end : end + 40].split()[:1]]
    out = []
    if len(before) == 2 and all(before):
        out.append(f"{before[0]} {before[1]} _")
    if before and after and before[-1] and after[0]:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to rule spans of each document and its occurrences: seeds and look-alikes with their patterns."""
    common.tune(docs.sparkSession)
    occurrence = pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("seed", pa.bool_()), ("inst", pa.int64()), ("pats", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import xxhash

        common.keeping("pii")

        number = lambda x: int.from_bytes(xxhash.xxh3_64_digest(x.encode("utf-8", "surrogatepass")), "big", signed=True)
        for b in batches:
            cols: dict[str, list] = {k: [] for k in ("row", *KINDS, "sha", "spans", "occ")}
            for text in b.column("text").to_pylist():
                text = text or ""
                spans = base(text)
                said = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                occ = [{"kind": k, "s": s, "e": e, "seed": True, "inst": number(f"{k} {text[s:e]}"), "pats": [number(p) for p in contexts(text, s, e)]} for k, s, e in spans]
                taken = sorted((s, e) for _, s, e in spans)
                for k, s, e in candidates(text, taken):
                    if found := contexts(text, s, e):
                        occ.append({"kind": k, "s": s, "e": e, "seed": False, "inst": number(f"{k} {text[s:e]}"), "pats": [number(p) for p in found]})
                cols["row"].append(number(text))
                for k in KINDS:
                    cols[k].append(sum(x[0] == k for x in spans))
                cols["sha"].append(hashlib.sha256(said.encode()).hexdigest())
                cols["spans"].append(said)
                cols["occ"].append(occ)
            kinds = {"row": pa.int64(), "sha": pa.string(), "spans": pa.string(), "occ": pa.list_(occurrence)}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items())], ["doc_id", "row_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base_spans", "occ"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, row_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, base_spans string, occ array<struct<kind:string,s:int,e:int,seed:boolean,inst:long,pats:array<long>>>")


def vouched(occ: DataFrame) -> DataFrame:
    """Instances (inst, kind) that are sure: seeds not among them. A pattern's score is the mean score of what it holds, an instance's the chance that any of its patterns is right."""
    edges = common.written(occ.select("kind", "inst", "seed", F.explode("pats").alias("pat")).distinct(), "pii-edges")
    held = edges.groupBy("pat").agg(F.count("*").alias("held"))
    fresh = edges.where("not seed")
    scores = edges.where("seed").select("kind", "inst").distinct().withColumn("score", F.lit(1.0))
    lifted = None
    for _ in range(ROUNDS):
        trust = edges.join(scores, ["kind", "inst"]).groupBy("pat", "kind").agg(F.sum("score").alias("good"), F.count_if("seed").alias("seeds"))
        trust = trust.where(F.col("seeds") >= LEAST_SEEDS).join(held, "pat").select("pat", "kind", F.least(F.lit(0.999), F.col("good") / (F.col("held") + 0.5)).alias("conf")).where("conf >= 0.5")
        lifted = fresh.join(trust, ["pat", "kind"]).groupBy("kind", "inst").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
        lifted = common.written(lifted, "pii-scores")
        scores = edges.where("seed").select("kind", "inst").distinct().withColumn("score", F.lit(1.0)).unionByName(lifted)
    return lifted.where(F.col("score") >= SURE).select("kind", "inst")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found).

    Counts and base_sha256 are of the strict rules, which always stay; spans has what the bootstrapping adds too,
    by kind and start. A null text is empty; texts of any length are read whole. Of spans that begin at one place the
    kind listed first comes first. Repeated rows give repeated results, rows without an id results without one; other
    columns are ignored; an empty table gives no rows.
    """
    rows = common.written(scanned(docs), "pii")
    occ = rows.select("doc_id", "row_id", F.explode("occ").alias("o")).select("doc_id", "row_id", "o.*")
    found = occ.where("not seed").join(vouched(occ), ["kind", "inst"], "left_semi")
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    added = found.select("doc_id", "row_id", F.struct(rank[F.col("kind")].alias("r"), "s", "e", "kind").alias("x")).distinct().groupBy("doc_id", "row_id").agg(F.collect_list("x").alias("extra"))
    told = F.transform("occ", lambda o: F.struct(rank[o.kind].alias("r"), o.s.alias("s"), o.e.alias("e"), o.kind.alias("kind"), o.seed.alias("seed")))
    own = F.transform(F.filter(told, lambda o: o.seed), lambda o: F.struct(o.r.alias("r"), o.s.alias("s"), o.e.alias("e"), o.kind.alias("kind")))
    all_spans = F.array_join(F.transform(F.sort_array(F.concat(own, "extra")), lambda o: F.concat_ws(":", o.kind, o.s, o.e)), ",")
    added = added.select(F.col("doc_id").alias("id"), F.col("row_id").alias("at"), "extra")
    out = rows.join(added, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_id") == F.col("at")), "left")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.when(F.col("extra").isNull(), F.col("base_spans")).otherwise(all_spans).alias("spans"), F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_found"))
