"""Personal data by weak supervision, in DataFrame operations only.

Base spans are the matches of one pattern per kind that pass its check. Wider patterns propose more spans: secrets,
local phone numbers, and emails and addresses written apart. Regular expressions, gazetteers and context vote on every
candidate, base ones included; EM over the vote patterns of the whole corpus estimates how reliable each labeler is;
a logistic span classifier is trained on the resulting probabilities, and adds candidates that it finds likely and
that overlap no base span.

A null text is empty. Every input row gives one row; a null doc_id stays null. Columns other than doc_id and text are
not read. An empty table gives no rows.

Positions come from splitting a text at marks set around matches, so they count code points. The patterns are written
so that a long run of one character is read once: possessive repeats, and no start within a run unless a match has
just ended there. Only vote and feature patterns, whose number the rules bound, reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import saved

_LOCAL = "A-Za-z0-9._%+-"
#: Kind, pattern, and a cheaper sign that a text may hold it.
BASE = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: Wider patterns, by the kind they propose.
WIDER = {
    "email": (r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}+)+", "at"),
    "phone": (r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    "secret": (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", r"[A-Za-z0-9_-]{20}"),
}
KINDS = [*BASE, "secret"]
#: Fixed words of the context and gazetteer labelers, in lower case.
CUES = "email|e-mail|mail|phone|tel|call|fax|mobile|card|visa|iban|token|secret|password|passwd|api_key|apikey|key|auth|bearer|ip|host|server|contact"
PROVIDERS = "gmail|googlemail|yahoo|ymail|outlook|hotmail|live|msn|proton|protonmail|icloud|me|aol|gmx|web|mail|yandex|qq|163|126|naver|daum|zoho|fastmail|hey|tutanota|comcast|verizon|example"
SECRET_PREFIXES = "sk_|sk-|pk_|rk_|ghp_|gho_|ghs_|github_pat_|glpat-|xox|akia|asia|eyj|aiza|ya29|npm_|pypi-|hf_|shpat_|dop_|sg\\."
#: Calling codes of countries, and addresses that belong to nobody in particular.
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-3]|50[0-9]|59[0-9]|67[0-9]|85[0-9]|88[0-9]|96[0-8]|97[0-9]|99[2-8]"
LOCAL_ADDRESSES = r"0|10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|169\.254|255"
#: Characters before a candidate that the context labeler reads.
NEAR = 24
LABELERS = ["pattern", "shape", "gazetteer", "context", "quoted"]
MARK = "\x01"
#: Items of an array that a scan goes through before it starts a new array.
CHUNK = 512


def let(value, use):
    """``use`` of a value that is made once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items, carry, none, step):
    """What ``step`` (carry, item) gives as out, an array like the empty one ``none``, over all items in order, where each
    step hands its carry on. Arrays grow inside chunks only, so the work grows with the items, not with their square."""
    last = F.greatest(F.ceil(F.size(items) / CHUNK).cast("int") - 1, F.lit(0))
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * CHUNK + 1, CHUNK))
    state = lambda c, out: F.struct(c.alias("carry"), out.alias("out"))

    def one(so_far, item):
        return let(step(so_far["carry"], item), lambda s: state(s["carry"], F.concat(so_far["out"], s["out"])))

    def chunk(so_far, own):
        return let(F.aggregate(own, state(so_far["carry"], none), one), lambda s: state(s["carry"], F.concat(so_far["out"], F.array(s["out"]))))

    return F.flatten(F.aggregate(chunks, state(carry, F.slice(F.array(none), 1, 0)), chunk)["out"])


SPAN = "struct<start:int,end:int,s:string,before:string,after:string>"


def spans_of(text, pattern: str, sign: str):
    """Array of the matches of ``pattern``: start, end, s, NEAR characters before and one after; empty where ``sign`` is
    not found."""
    may = text.contains(sign) if len(sign) <= 2 else text.rlike(sign)
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK)
    none = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("k"), F.lit("").alias("tail"))

    def found(all_parts):
        def step(at, part):
            stop, head = at["pos"] + F.length(part), lambda k: F.left(F.get(all_parts, at["k"] + k), F.lit(1))
            after = F.coalesce(F.nullif(head(1), F.lit("")), head(2), F.lit(""))
            span = F.struct(at["pos"].alias("start"), stop.alias("end"), part.alias("s"), at["tail"].alias("before"), after.alias("after"))
            carry = F.struct(stop.alias("pos"), (at["k"] + 1).alias("k"), F.right(F.concat(at["tail"], part), F.lit(NEAR)).alias("tail"))
            return F.struct(carry.alias("carry"), F.when(at["k"] % 2 == 1, F.array(span)).otherwise(none).alias("out"))

        return scan(all_parts, zero, none, step)

    return F.when(may, let(parts, found)).otherwise(none)


def luhn(digits):
    n = F.length(digits)

    def add(total, k):
        d = F.ascii(F.substring(digits, n - k, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def passes(kind: str, s):
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def base_spans(text) -> dict:
    checked = lambda kind, found: F.filter(found, lambda m: passes(kind, m["s"]))
    return {kind: checked(kind, spans_of(text, pattern, sign)) for kind, (pattern, sign) in BASE.items()}


def named(kind: str, found):
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), *(m[c].alias(c) for c in ("start", "end", "s", "before", "after"))))


def proposed(text):
    """Array of the matches of the wider patterns, with their kinds. A secret needs a digit and a letter, which sorts
    out long words."""
    out = []
    for kind, (pattern, sign) in WIDER.items():
        found = spans_of(text, pattern, sign)
        if kind == "secret":
            found = F.filter(found, lambda m: m["s"].rlike("[0-9]") & m["s"].rlike("[A-Za-z]"))
        out.append(named(kind, found))
    return F.concat(*out)


def free(base, more):
    """Those of ``more`` that overlap none of ``base``, by two scans in order of their starts: one for base spans that
    begin before or with them, one back for those that begin within."""
    own = "struct<kind:string,start:int,end:int,s:string,before:string,after:string>"
    none = F.array().cast(f"array<struct<start:int,extra:int,end:int,m:{own}>>")
    placed = lambda spans, extra: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(extra).alias("extra"), m["end"].alias("end"), m.alias("m")))
    every = F.sort_array(F.concat(placed(base, 0), placed(more, 1)))

    def ahead(reach, x):
        kept = (x["extra"] == 0) | (reach <= x["start"])
        return F.struct(F.when(x["extra"] == 0, F.greatest(reach, x["end"])).otherwise(reach).alias("carry"), F.when(kept, F.array(x)).otherwise(none).alias("out"))

    def back(near, x):
        kept = (x["extra"] == 1) & (near >= x["end"])
        return F.struct(F.when(x["extra"] == 0, F.least(near, x["start"])).otherwise(near).alias("carry"), F.when(kept, F.array(x)).otherwise(none).alias("out"))

    def both(spans):
        return let(scan(spans, F.lit(0), none, ahead), lambda left: let(F.reverse(left), lambda turned: scan(turned, F.lit(2**31 - 1), none, back)))

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(F.transform(let(every, both), lambda x: x["m"]))


def apart(spans):
    """Of spans that overlap each other, one that begins at the same place as another or within it goes."""
    short = F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")

    def step(reach, x):
        return F.struct(F.greatest(reach, x["end"]).alias("carry"), F.when(reach <= x["start"], F.array(x)).otherwise(none).alias("out"))

    return F.when(F.size(spans) < 2, short).otherwise(let(F.sort_array(short), lambda x: scan(x, F.lit(0), none, step)))


def labelled(span, base: bool):
    """A candidate with its votes (1 personal, 0 not, null abstains) and the features of the span classifier."""
    s, kind, before, after = span["s"], span["kind"], F.lower(span["before"]), span["after"]
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    cue = before.rlike(rf"\b(?:{CUES})\b[^a-z]*$")
    quoted = before.rlike(r"""["'=:]\s*["']?$""")
    hexed = s.rlike("^[0-9a-fA-F]{24,}$")
    mixed = s.rlike("[a-z]") & s.rlike("[A-Z]") & (digits > 2)
    votes = {
        "pattern": F.lit(1) if base else F.when(kind == "phone", 1),
        "shape": F.when(kind == "secret", F.when(hexed | mixed, 1).when(digits * 5 < F.length(s), 0)).when(kind == "ip", F.when(s.rlike(r"^(?:0|127)\."), 0).otherwise(1)).when(kind == "card", F.when(s.rlike("^[3-6]"), 1).otherwise(0)),
        "gazetteer": F.when((kind == "email") & F.lower(s).rlike(rf"@(?:[a-z0-9-]+\.)*(?:{PROVIDERS})"), 1).when((kind == "secret") & F.lower(s).rlike(f"^(?:{SECRET_PREFIXES})"), 1)
        .when((kind == "phone") & s.rlike(rf"^\+(?:{CALLING})"), 1).when((kind == "ip") & s.rlike(rf"^(?:{LOCAL_ADDRESSES})\."), 0),
        "context": F.when(cue, 1).when(before.rlike(r"\b(?:version|v|isbn|id|no|sku|figure|page)\b[^a-z]*$"), 0),
        "quoted": F.when(quoted & after.rlike("^[\"']"), 1).when((kind == "secret") & ~quoted, 0),
    }
    features = F.concat_ws(
        "|", kind, F.least(F.length(s) / 10, F.lit(5)).cast("int").cast("string"),
        F.when(hexed, "hex").when(mixed, "mixed").when(digits * 2 > F.length(s), "digits").otherwise("other"),
        F.when(cue, "cue").when(quoted, "quoted").otherwise("bare"), F.when(after.rlike("^[A-Za-z0-9]"), "on").otherwise("off"),
    )
    return F.struct(kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.array(*(F.coalesce(v, F.lit(-1)).cast("int") for v in votes.values())).alias("votes"), features.alias("features"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind, start, end, votes, features) in output order, more (the same, of proposals that overlap no
    base span), one row per row of ``docs``."""
    # a mark that stands in the text itself is no part of any match, so another control may stand for it
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK, "\x02")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t"))
    found = rows.select("doc_id", "_t", *(v.alias(f"_{k}") for k, v in base_spans(F.col("_t")).items()), proposed(F.col("_t")).alias("_more"))
    found = found.select("doc_id", F.concat(*(named(k, F.col(f"_{k}")) for k in BASE)).alias("_base"), "_more")
    found = found.select("doc_id", "_base", free(F.col("_base"), F.col("_more")).alias("_more"))
    return found.select("doc_id", F.transform("_base", lambda m: labelled(m, True)).alias("base"), F.transform("_more", lambda m: labelled(m, False)).alias("more"))


def label_model(votes: np.ndarray, count: np.ndarray, rounds: int = 40) -> np.ndarray:
    """EM: probability that candidates with each vote pattern are personal. Each labeler has one rate of right votes
    per class, held by a prior to being better than chance."""
    yes, no = votes == 1, votes == 0
    post = np.where(yes.sum(1) > no.sum(1), 0.9, np.where(yes.sum(1) < no.sum(1), 0.1, 0.5))
    prior = 5.0 + 0.02 * count.sum()
    for _ in range(rounds):
        a, b = post * count, (1 - post) * count
        share = (a.sum() + prior * 0.5) / (count.sum() + prior)
        hit = ((a[:, None] * yes).sum(0) + 0.8 * prior) / ((a[:, None] * (yes | no)).sum(0) + prior)
        miss = ((b[:, None] * no).sum(0) + 0.8 * prior) / ((b[:, None] * (yes | no)).sum(0) + prior)
        logit = np.log(share / (1 - share)) + (yes * np.log(hit / (1 - miss)) + no * np.log((1 - hit) / miss)).sum(1)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post


def fit_spans(features: list[list[str]], target: np.ndarray, count: np.ndarray, rounds: int = 400) -> dict[str, float]:
    """Logistic regression over one-hot features on soft labels: weight by feature, and by '' for the bias."""
    names = {f: k + 1 for k, f in enumerate(sorted({f for x in features for f in x}))}
    x = np.zeros((len(features), len(names) + 1))
    x[:, 0] = 1
    for r, row in enumerate(features):
        x[r, [names[f] for f in row]] = 1
    w, share = np.zeros(x.shape[1]), count / max(count.sum(), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ ((p - target) * share) + 1e-4 * w)
    return {"": float(w[0]), **{f: float(w[k]) for f, k in names.items()}}


def _named(features: str) -> list[str]:
    kind, size, shape, cue, after = features.split("|")
    return [kind, f"{kind} size {size}", f"{kind} {shape}", f"{kind} {cue}", after]


def find_pii(docs: DataFrame, above: float = 0.5) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end), one row per row of ``docs``. Texts are read once; the
    candidates are written out, which is little beside the texts."""
    found = saved(candidates(docs))
    each = found.select(F.explode(F.concat("base", "more")).alias("c"))
    seen = each.groupBy("c.votes", "c.features").count().collect()
    votes = np.array([r["votes"] for r in seen], int).reshape(-1, len(LABELERS))
    count = np.array([r["count"] for r in seen], float)
    weights = fit_spans([_named(r["features"]) for r in seen], label_model(votes, count), count) if seen else {"": 0.0}
    likely = sorted({r["features"] for r in seen if sum(weights[f] for f in ["", *_named(r["features"])]) > np.log(above / (1 - above))})
    short = lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    keep = F.filter("more", lambda m: m["features"].isin(likely)) if likely else F.filter("more", lambda m: F.lit(False))
    chosen = found.select("doc_id", F.transform("base", short).alias("base"), keep.alias("_keep"))
    return chosen.select("doc_id", "base", F.transform(apart(F.col("_keep")), short).alias("added"))


def _joined(spans):
    """kind:start:end, by kind as listed, then start, with commas between."""
    order = F.sort_array(F.transform(spans, lambda m: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), m["kind"]).alias("k"), m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def count_kind(kind: str, spans: str = "base"):
    return F.size(F.filter(spans, lambda m: m["kind"] == kind)).cast("long")


def op10_pii(spark, sf_dir):
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.sha2(_joined(F.col("base")), 256).alias("base_sha256")
    more = [count_kind(k, "added").alias(f"n_{k}") for k in KINDS if k not in BASE]
    return found.select("doc_id", *(count_kind(k).alias(f"n_{k}") for k in BASE), digest, _joined(F.concat("base", "added")).alias("spans"), *more, F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
