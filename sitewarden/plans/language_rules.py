"""Rules on language annotations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitewarden.functions import text as T
from sitewarden.functions import urls as U
from sitewarden.operators.algebra import Output, Spec, draft_struct, evaluate_specs, gate_rows
from sitewarden.operators.evidence import UNSETTLED, Evidence, pointer
from sitewarden.plans.config import AuditConfig
from sitewarden.plans.page_rules import _say
from sitewarden.sources.tables import checkpoint

#: Frequent words by language.
WORDS = {
    "en": "the this that with from have were their they not",
    "es": "que los las una del por para como más pero sus está",
    "fr": "les des une dans pour qui est pas plus sont aux cette",
    "de": "und der die das den nicht ich sie ein eine auf auch",
    "pt": "não uma para mais como mas dos das pela pelo está são",
    "it": "che per non una sono più della degli anche come questo",
}
#: language[-script][-region].
TAG = r"^[a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?$"


@F.pandas_udf(StringType())
def _two_places(x: pd.Series) -> pd.Series:
    """Two decimal places of the exact binary value; the JVM rounds its shortest decimal form."""
    return x.map("{:.2f}".format, na_action="ignore")


def valid_tag(tag: Column) -> Column:
    low = T.ascii_lower(F.trim(tag))
    return (low == "x-default") | low.rlike(TAG)


def primary(tag: Column) -> Column:
    """The language of a tag; null for x-default and what isn't a language."""
    low = T.ascii_lower(F.trim(tag))
    return F.when(low != "x-default", F.nullif(F.regexp_extract(low, "^([a-z]{2,3})([-_].*)?$", 1), F.lit("")))


def detect(text: Column) -> Column:
    """The language whose frequent words a text has most of, as struct(lang, hits, confidence); null without any."""
    listed = sorted({w for own in WORDS.values() for w in own.split()})
    words = F.filter(F.split(T.ascii_lower(text), r"[^\p{IsAlphabetic}]+"), lambda w: (F.octet_length(w) >= 2) & w.isin(*listed))

    def once(value: Column, use) -> Column:
        """use(value), with value evaluated once however often use names it."""
        return F.transform(F.array(value), use)[0]

    def hits(words: Column, own: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*own.split())))

    def best(scores: Column) -> Column:
        most, total = F.array_max(scores), F.aggregate(scores, F.lit(0), lambda n, s: n + s["hits"])
        return F.when(total > 0, F.struct(most["lang"].alias("lang"), most["hits"].alias("hits"), (most["hits"] / total).alias("confidence")))

    return once(once(words, lambda w: F.array(*(F.struct(hits(w, own).alias("hits"), F.lit(lang).alias("lang")) for lang, own in WORDS.items()))), best)


def annotations(ev: Evidence) -> DataFrame:
    """The annotations of complete pages by position: lang, href, target (resolved), preferred, self."""
    rows = ev.complete_pages.where(F.size("hreflangs") > 0).select("identity", "key", "in_crawl", "hreflangs", F.try_element_at("canonicals", F.lit(1)).alias("_c"), F.posexplode("hreflangs").alias("pos", "h"))
    rows = rows.withColumn("preferred", F.coalesce(U.resolve_of(F.col("identity"), F.col("_c")), "key")).withColumn("target", U.resolve_of(F.col("identity"), F.col("h.href")))
    return rows.select("identity", "key", "in_crawl", "preferred", "pos", "h.lang", "h.href", "target", (F.col("target").isin(F.col("key"), F.col("preferred"))).alias("own"), F.array_join(F.transform("hreflangs", lambda h: F.concat(h["lang"], F.lit(" -> "), h["href"])), " | ").alias("listing"))


def _gate(ev: Evidence, rule: str, rows: DataFrame, unknown: Column | None = None) -> DataFrame:
    one = rows.agg(F.count("*").alias("n"), F.count_if(F.lit(False) if unknown is None else unknown).alias("u")).join(F.broadcast(ev.page_counts))
    any_page = F.col("n_complete") > 0
    return gate_rows(one, rule, ~any_page | (F.col("n") > 0), any_page & (F.col("u") == 0))


def invalid(ev: Evidence) -> Output:
    rows = annotations(ev)
    spec = Spec("hreflang.values_invalid", ~valid_tag(F.col("lang")), _say(F.col("identity"), " hreflang=", F.col("lang")), _say("The language tag '", F.col("lang"), "' isn't valid."), "Use a BCP 47 tag or x-default.", [pointer("identity", "hreflang", _say(F.col("lang"), " -> ", F.col("href")))], ord=_say(F.col("identity"), "\t", F.lpad(F.col("pos").cast("string"), 9, "0")))
    return Output([_gate(ev, spec.rule_id, rows)], evaluate_specs(rows, [spec], ev.page_counts, "n_complete").drafts)


def conflicts(ev: Evidence) -> Output:
    rule = "hreflang.source_conflicts"
    rows = annotations(ev).withColumn("target", F.coalesce("target", "href")).withColumn("low", T.ascii_lower(F.trim("lang")))
    listed = F.sort_array(F.collect_list(F.struct("pos", "lang", "target")))
    groups = rows.groupBy("identity", "low").agg(listed.alias("l")).select("identity", "low", F.col("l")[0]["lang"].alias("lang"), F.array_distinct(F.transform("l", lambda x: x["target"])).alias("targets"))
    joined = F.array_join("targets", " | ")
    drafts = groups.where(F.size("targets") > 1).select(draft_struct(rule, _say(F.col("identity"), " hreflang=", F.col("lang")), _say("One language has several addresses: ", joined), "Keep one address for each language.", F.array(pointer("identity", "hreflang", _say(F.col("lang"), " -> ", joined))), _say(F.col("identity"), "\t", F.col("low"))).alias("d")).select("d.*")
    return Output([_gate(ev, rule, rows)], [drafts])


def incorrect(ev: Evidence) -> Output:
    """hreflang.incorrect_links: targets that can't be resolved or used, that don't link back, and missing self-references."""
    rule = "hreflang.incorrect_links"
    rows = annotations(ev).where("in_crawl")
    first = rows.where("target is not null").groupBy("identity", "target").agg(F.min("pos").alias("pos")).withColumn("first", F.lit(True))
    fetch = ev.fetches.select(F.col("key").alias("k2"), "fetch")
    known = ev.targets.join(fetch, F.col("key") == F.col("k2"), "full_outer").select(F.coalesce("key", "k2").alias("target"), F.struct("state", "status", "failed_reason", "noindex", F.coalesce("observed", F.lit(False)).alias("observed"), "observed_identity", "canonicals", "fetch").alias("t"))
    # pages that link back: (page, address it is reached by)
    back = annotations(ev).where("target is not null").select(F.col("key").alias("target"), F.col("target").alias("reached")).distinct()
    rows = rows.join(first, ["identity", "target", "pos"], "left").join(known, "target", "left")
    to_key = back.select("target", F.col("reached").alias("key"), F.lit(True).alias("b1"))
    to_preferred = back.select("target", F.col("reached").alias("preferred"), F.lit(True).alias("b2"))
    rows = rows.join(to_key, ["target", "key"], "left").join(to_preferred, ["target", "preferred"], "left")
    t = F.col("t")
    rows = rows.withColumn("their", F.coalesce(U.resolve_of(t["observed_identity"], F.try_element_at(t["canonicals"], F.lit(1))), F.when(t["observed"], F.col("target"))))
    status = F.coalesce(F.when(t["observed"], t["status"]), t["fetch"]["status"], t["status"])
    reason = F.coalesce(t["fetch"]["failed_reason"], t["failed_reason"])
    counted = F.coalesce("first", F.lit(False))
    has_fetch = t["fetch"].isNotNull()
    unsettled = F.coalesce(t["state"].isin(*UNSETTLED), F.lit(False)) & ~t["observed"] & ~has_fetch
    stopped = status.between(400, 599) | reason.isNotNull() | F.coalesce(t["fetch"]["robots_blocked"], F.lit(False))
    missing = counted & (t.isNull() | unsettled | (~F.coalesce(stopped, F.lit(False)) & ~t["observed"] & status.isNull()))
    arrow = _say(F.col("lang"), " -> ", F.col("target"))

    def draft(n: int, fact: str, own: Column, who: Column, field: str, excerpt: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), F.lit(fact).alias("fact"), own.alias("own"), who.alias("who"), F.lit(field).alias("field"), excerpt.cast("string").alias("excerpt"))

    target = F.col("target")
    usable = counted & ~unsettled & t.isNotNull()
    bad_status, failed = F.coalesce(status.between(400, 599), F.lit(False)), reason.isNotNull()
    blocked = F.coalesce(t["fetch"]["robots_blocked"], F.lit(False))
    good = usable & ~bad_status & ~failed & ~blocked & t["observed"]
    returns = F.coalesce("b1", F.lit(False)) | F.coalesce("b2", F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(target.isNull(), draft(0, "can't be resolved", _say(F.col("lang"), " -> ", F.col("href")), F.col("href"), "hreflang", F.lit("unresolvable href"))),
        F.when(usable & bad_status, draft(1, "answers an error", _say(arrow, " HTTP ", status.cast("string")), target, "target_http_status", status)),
        F.when(usable & ~bad_status & failed, draft(2, "can't be reached", arrow, target, "target_http_status", reason)),
        F.when(usable & ~bad_status & ~failed & blocked, draft(3, "is blocked by robots.txt", arrow, target, "target_http_status", F.lit("robots blocked"))),
        F.when(good & t["noindex"], draft(4, "forbids indexing", arrow, t["observed_identity"], "robots", F.lit("noindex"))),
        F.when(good & (F.col("their") != target), draft(5, "has another canonical", arrow, t["observed_identity"], "canonical", F.col("their"))),
        F.when(good & ~F.col("own") & ~returns, draft(6, "doesn't link back", arrow, t["observed_identity"], "hreflang", F.col("their_listing"))),
    ))
    theirs = ev.pages.groupBy("key").agg(F.max_by(F.array_join(F.transform("hreflangs", lambda h: F.concat(h["lang"], F.lit(" -> "), h["href"])), " | "), "identity").alias("their_listing")).withColumnRenamed("key", "target")
    rows = rows.join(theirs, "target", "left")
    found = rows.select("identity", "lang", "href", "target", "pos", F.explode(reasons).alias("r"))
    order = _say(F.col("identity"), "\t", F.lpad(F.col("pos").cast("string"), 9, "0"), F.col("r.n").cast("string"))
    points = F.array(pointer("identity", "hreflang", F.col("r.own")), pointer(F.col("r.who"), "hreflang", F.col("r.excerpt")).withField("field", F.col("r.field")))
    drafts = found.select(draft_struct(rule, _say(F.col("identity"), " hreflang=", F.col("lang"), " -> ", F.coalesce("target", "href")), _say("The annotated address ", F.coalesce("target", "href"), " ", F.col("r.fact"), "."), "Annotate canonical addresses that answer, can be indexed and link back.", points, order).alias("d")).select("d.*")
    alone = rows.groupBy("identity").agg(F.max(F.coalesce("own", F.lit(False))).alias("own"), F.max("preferred").alias("preferred"), F.max("listing").alias("listing")).where("not own")
    selfless = alone.select(draft_struct(rule, _say(F.col("identity"), " self-reference"), _say("The annotations leave out the page itself, ", F.col("preferred")), "Annotate the page itself.", F.array(pointer("identity", "hreflang", F.col("listing")), pointer("preferred", "hreflang", "self-reference missing"))).alias("d")).select("d.*")
    return Output([_gate(ev, rule, rows, F.coalesce(missing, F.lit(False)))], [drafts, selfless])


def _read(ev: Evidence) -> DataFrame:
    """(identity, html_lang, found) of complete pages: texts are read once, and no text goes into a join or to Python."""
    flags = F.col("page.flags")
    complete = ~(flags["truncated"] | flags["challenge"] | flags["error_status"] | flags["non_html"] | flags["encoding_fallback"])
    return checkpoint(ev.observations.where(complete).select("identity", "page.html_lang", detect(F.col("page.text")).alias("found")))


def mismatch(ev: Evidence, cfg: AuditConfig) -> Output:
    rule = "hreflang.language_mismatch"
    hits, confidence = cfg.number("min_language_hits"), cfg.number("min_language_confidence")
    own = annotations(ev).where("own").withColumn("p", primary(F.col("lang"))).where("p is not null").groupBy("identity").agg(F.min_by("p", "pos").alias("self_lang"), F.max("listing").alias("listing"))
    rows = ev.with_crawl(U.with_identity(_read(ev), F.col("identity"), "key")).where("in_crawl").select("identity", "html_lang", "found").join(own, "identity", "left")
    rows = rows.withColumn("page_lang", primary(F.col("html_lang"))).withColumn("declared", F.coalesce("page_lang", "self_lang")).where("declared is not null")
    f = F.col("found")
    specs = [
        Spec(rule, F.col("page_lang") != F.col("self_lang"), _say(F.col("identity"), " declared"), _say("The page says ", F.col("page_lang"), ", its annotation ", F.col("self_lang")), "Let the declarations agree.", [pointer("identity", "html_lang", F.col("html_lang")), pointer("identity", "hreflang", F.col("listing"))]),
        Spec(rule, (f["hits"] >= hits) & (f["confidence"] + 2.220446049250313e-16 >= confidence) & (f["lang"] != F.col("declared")), _say(F.col("identity"), " content"), _say("The page says ", F.col("declared"), ", its text reads like ", f["lang"]), "Review text and annotations; the detection is a heuristic.", [pointer("identity", "text_language", _say(f["lang"], " confidence=", _two_places(f["confidence"])))]),
    ]
    drafts = [d for s in specs for d in evaluate_specs(rows, [s], ev.page_counts, "n_complete").drafts]
    return Output([_gate(ev, rule, rows)], drafts)


def evaluate(ev: Evidence, cfg: AuditConfig, wanted: set[str]) -> list[Output]:
    out = []
    if "hreflang.values_invalid" in wanted:
        out.append(invalid(ev))
    if "hreflang.source_conflicts" in wanted:
        out.append(conflicts(ev))
    if "hreflang.incorrect_links" in wanted:
        out.append(incorrect(ev))
    if "hreflang.language_mismatch" in wanted:
        out.append(mismatch(ev, cfg))
    return out


RULES = ["hreflang.values_invalid", "hreflang.source_conflicts", "hreflang.incorrect_links", "hreflang.language_mismatch"]
