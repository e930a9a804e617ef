"""URL filter: rules first, then trust and distrust over the host graph.

A rule (host and path prefix) decides the urls it fits; the longest wins.
A host is a trusted seed if the rules allow more of its pages than they block,
a blocked seed if they block more; pages without a rule do not count, and the
pages that count are the seed's weight. Personalised PageRank carries trust along the host
edges and distrust against them (who links to a blocked host is suspect).
A url without a rule is blocked if its host's distrust exceeds its trust and
is at least `floor` times an even share; else it is allowed.

Host edges: links to an absolute url of another host, and, both ways, a host
and its parent domain, that and its own parent and so on down to the
registrable domain (two labels, or three under a country's co, com, ac ...;
there is no list of public suffixes here). Domains between are nodes whether
or not they serve pages, so siblings meet in them; an address with a port is
a child of the one without. Everything is DataFrame work:
edges and seeds are summed before each shuffle, so a host with a third of all
pages is one row of the graph. Mass at a host without edges ends there.

Defined cases: a null url or one without :// has empty host and path and no
rule; such pages take part like those of any host; null html has no links;
repeated rows are judged each; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquiro.llm.common import lower_az, materialize

#: (verdict, rule): a rule is a host, then a path prefix from its first /.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A host name, not an IP address; and one under a country's second level.
_DOMAIN, _COUNTRY = r"^[^.:]+(\.[^.:]+)*\.[^.:0-9]+[^.:]*$", r"\.(ac|co|com|edu|go|gob|gov|gouv|mil|ne|net|or|org)\.[a-z]{2}$"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/"'?#\s>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    return lower_az(F.regexp_extract(whole, _PARTS, 1)), F.regexp_extract(whole, _PARTS, 2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def family_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst): each host and domain above it with its parent, both ways."""
    bare = F.regexp_replace("host", r"^.*@|:[0-9]*$", "")
    chain = hosts.select("host", bare.alias("bare"), F.split(bare, r"\.").alias("labels")).select(
        "host", "bare", F.when(F.col("bare").rlike(_DOMAIN), F.size("labels") - F.when(F.col("bare").rlike(_COUNTRY), 3).otherwise(2)).otherwise(0).alias("above"), "labels"
    )
    domain = "array_join(slice(labels, {0} + 1, size(labels)), '.')"
    steps = chain.filter("above > 0").selectExpr("labels", "explode(sequence(1, above)) as i").selectExpr(f"{domain.format('(i - 1)')} as src", f"{domain.format('i')} as dst")
    up = steps.unionByName(chain.filter("host != bare and bare != ''").selectExpr("host as src", "bare as dst")).distinct()
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, w): links between hosts and domains above them, summed."""
    family = materialize(family_edges(hosts))
    nodes = hosts.select(F.col("host").alias("dst")).unionByName(family.select("dst")).distinct()
    host, _ = url_parts(F.col("url"))
    links = (
        pages.filter(F.col("html").contains("//"))
        .select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
        .select("src", lower_az(F.col("dst")).alias("dst"))
        .filter(F.col("src") != F.col("dst"))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("w"))
        .join(nodes, "dst", "left_semi")
    )
    return links.select("src", "dst", "w").unionByName(family.withColumn("w", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(hosts: DataFrame, edges: DataFrame, *, damping: float = 0.85, rounds: int = 24, block: int = 4, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust) after personalised PageRank from the seeds.

    hosts has host, trusted and blocked (seed weights); the loop writes its
    state every `block` rounds and stops when a block moves it by less than
    `tolerance` in all.
    """
    steps = materialize(
        edges.join(edges.groupBy("src").agg(F.sum("w").alias("out")), "src")
        .select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("w") / F.col("out")).alias("share"))
        .unionByName(
            edges.join(edges.groupBy("dst").agg(F.sum("w").alias("into")), "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), (F.col("w") / F.col("into")).alias("share"))
        )
    )
    sums = hosts.agg(F.sum("trusted").alias("a"), F.sum("blocked").alias("b")).first()
    seeds = materialize(
        hosts.selectExpr("host as at", f"stack(2, 'trust', cast(trusted as double) / {float(sums['a'] or 1)}, 'distrust', cast(blocked as double) / {float(sums['b'] or 1)}) as (kind, r)").filter("r > 0")
    )
    state, done = seeds.select("kind", "at", "r"), 0
    while done < rounds:
        new = state
        for _ in range(min(block, rounds - done)):
            moved = new.join(steps, ["kind", "at"]).select("kind", F.col("to").alias("at"), (F.col("r") * F.col("share") * damping).alias("r"))
            new = moved.unionByName(seeds.select("kind", "at", (F.col("r") * (1 - damping)).alias("r"))).groupBy("kind", "at").agg(F.sum("r").alias("r"))
            done += 1
        new = materialize(new)
        scale = new.groupBy("kind").agg(F.sum("r").alias("all"))
        shift = (
            new.join(F.broadcast(scale), "kind").select("kind", "at", (F.col("r") / F.col("all")).alias("r"))
            .unionByName(state.join(F.broadcast(state.groupBy("kind").agg(F.sum("r").alias("all"))), "kind").select("kind", "at", (-F.col("r") / F.col("all")).alias("r")))
            .groupBy("kind", "at").agg(F.abs(F.sum("r")).alias("d")).agg(F.sum("d")).first()[0]
        ) or 0.0
        state = new
        if shift < tolerance:
            break
    scale = F.broadcast(state.groupBy("kind").agg(F.sum("r").alias("all")))  # two rows
    scores = state.join(scale, "kind").groupBy(F.col("at").alias("host")).agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("r") / F.col("all")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("r") / F.col("all")).otherwise(0.0)).alias("distrust")
    )
    return hosts.select("host").join(scores, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, *, floor: float = 1.0, damping: float = 0.85, rounds: int = 24) -> DataFrame:
    """A verdict for every row of pages(page_id, url, html).

    Returns page_id, host, path, rule, verdict, trust and distrust. `rules`
    is configuration: a list of (verdict, rule), turned into one expression.
    """
    host, path = url_parts(F.col("url"))
    ruled = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = ruled.withColumns({"rule": rule, "said": said})
    hosts = materialize(
        ruled.groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("a"), F.count_if(F.col("said") == "block").alias("b"))
        .select("host", F.when(F.col("a") > F.col("b"), F.col("a")).otherwise(0).alias("trusted"), F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(0).alias("blocked"))
    )
    edges = materialize(host_edges(pages.select("url", "html"), hosts))
    scores = propagate(hosts, edges, damping=damping, rounds=rounds)
    even = F.lit(floor / max(1, hosts.select("host").union(edges.select("dst")).distinct().count()))
    verdict = F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= even), "block").otherwise("allow")
    return ruled.join(scores.select("host", "trust", "distrust", verdict.alias("by_links")), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", "by_links").alias("verdict"), "trust", "distrust")
