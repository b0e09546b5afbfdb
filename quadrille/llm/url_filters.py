"""URL filters: pattern rules indexed by their rarest literal token, regular expressions only for candidates.

A rule is a regular expression with the literal tokens that every URL it matches must hold. The index maps one
token of each rule, the one that fewest URLs of the table hold, to the rule. A URL's tokens fetch candidates
from that index, and only those expressions run. All of it is built-in Spark SQL. An index of up to IN_PLAN rules is a
literal of the plan and shuffles no URL; a larger one is a table that the distinct URLs' tokens join.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rules whose index is held in the plan.
IN_PLAN = 400


@dataclass(frozen=True)
class Rule:
    """``regex`` runs over ``host + path``; ``tokens`` are lower-case literals that a match always has as whole tokens."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    weight: int

    def __post_init__(self):
        re.compile(self.regex)
        if self.verdict not in ("allow", "block") or not self.tokens:
            raise ValueError(f"a rule needs a verdict and a token: {self}")


def site(verdict: str, place: str, named: bool = True) -> Rule:
    """The rule ``host/path``: that host and its subdomains, paths that start so; the longest wins."""
    host, slash, rest = place.partition("/")
    path = slash + rest
    whole = [x for x in re.split(r"[^0-9a-z]+", host)] + [x for x in re.split(r"[^0-9a-z]+", path.lower())[:-1]]
    return Rule(place if named else "", verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(x for x in whole if x)), len(place))


def term(verdict: str, words: str) -> Rule:
    """Any URL with ``words`` as whole tokens of its host or path, one after the other with a sign between them."""
    tokens = tuple(words.split())
    return Rule(words, verdict, rf"(?i)(?:^|[^0-9a-z]){'[^0-9a-z]'.join(map(re.escape, tokens))}(?:[^0-9a-z]|$)", tokens, 0)


def ending(verdict: str, kind: str) -> Rule:
    """Any URL whose path ends with the file ending ``kind``."""
    return Rule("." + kind, verdict, rf"(?i)/[^/]*[.]{re.escape(kind)}$", (kind,), 0)


#: The site rules of the standard run, and the method's own pattern rules where none of those fits.
SITE_RULES = (site("allow", "com/"), site("block", "example.com/en/"), site("allow", "www.example.com/en/"), site("block", "net/es/"), site("block", "net/fr/"))
#: Words and endings of the method's own rules: gambling, adult, fraud and malware, piracy, drugs, link schemes, programs.
TERMS = """
baccarat bettingtips blackjack bookie bookmaker casino casinos jackpot pokies roulette slotmachine slots sportsbet sportsbook
adultchat bdsm camgirl camgirls erotica escort escorts fetish hentai hookup milf nsfw nudes porn porno pornography sexcam sexchat striptease xxx
botnet carding cracked ddos exploitkit fakeid fullz hacktool keylogger malware phishing ransomware scam skimmer spyware stealer trojan virus
crack cracks keygen nulled pirated torrent torrents warez
cannabis cialis cocaine kratom levitra phentermine steroids tramadol viagra xanax
backlinks clickbait doorway linkfarm spinner spam spammy
""".split()
PHRASES = """free money|get rich|make money fast|work from home|buy followers|buy likes|buy viagra|cheap pills|online casino|poker online|sports betting|live sex|sex cam|adult dating|full movie download|serial key|license key generator|credit card numbers|weight loss pills|miracle cure|binary options|payday loan|payday loans|miracle diet|crypto giveaway|double your bitcoin|replica watches|fake passport|essay writing service|guest post links""".split("|")
ENDINGS = "apk bat cab cmd com exe jar msi pif ps1 scr vbs".split()
TERM_RULES = (*(term("block", w) for w in TERMS), *(term("block", w) for w in PHRASES), *(ending("block", w) for w in ENDINGS))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens_of(place: Column) -> Column:
    return F.array_distinct(F.split(F.translate(place, UPPER, LOWER), "[^0-9a-z]+"))


def token_counts(urls: DataFrame, place: Column, tokens: list[str]) -> dict[str, int]:
    """URLs of the whole table that hold each of ``tokens``; as many rows as the rules have tokens."""
    held = urls.select(F.explode(tokens_of(place)).alias("t"))
    if len(tokens) <= IN_PLAN:
        held = held.where(F.col("t").isin(tokens))
    else:
        held = held.join(urls.sparkSession.createDataFrame([(t,) for t in tokens], "t string"), "t", "left_semi")
    return {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def _by_token(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Each rule under that of its tokens which fewest URLs hold."""
    out: dict[str, list[Rule]] = defaultdict(list)
    for r in rules:
        out[min(r.tokens, key=lambda t: (counts.get(t, 0), t))].append(r)
    return out


def _lookup(rules: tuple[Rule, ...], counts: dict[str, int], place: Column) -> Column:
    """The heaviest rule that matches ``place``, as a struct (null: none)."""
    entry = lambda r: F.struct(F.lit(r.weight).alias("weight"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"))
    parts = [x for t, own in _by_token(rules, counts).items() for x in (F.lit(t), F.array(*[entry(r) for r in own]))]
    index = F.create_map(*parts)
    found = F.flatten(F.filter(F.transform(tokens_of(place), lambda t: F.try_element_at(index, t)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(found, lambda r: F.rlike(place, r["regex"])))


def _joined(named: DataFrame, rules: tuple[Rule, ...], counts: dict[str, int], place: Column, found: str) -> DataFrame:
    """``named`` with the same struct as ``_lookup`` gives, by a join of the distinct places' tokens with the index."""
    rows = [(t, r.weight, r.name, r.verdict, r.regex) for t, own in _by_token(rules, counts).items() for r in own]
    index = named.sparkSession.createDataFrame(rows, "token string, weight int, name string, verdict string, regex string")
    tokens = named.select(place.alias("_place")).distinct().select("_place", F.explode(tokens_of(F.col("_place"))).alias("token"))
    best = tokens.join(index, "token").where(F.rlike("_place", F.col("regex"))).groupBy("_place").agg(F.max(F.struct("weight", "name", "verdict", "regex")).alias(found))
    return named.withColumn("_place", place).join(best, "_place", "left").drop("_place")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES, terms: tuple[Rule, ...] = TERM_RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The heaviest of ``rules`` that fits decides and is named; where none fits, ``terms`` decide without a name,
    and otherwise the verdict is allow. A null URL, or one without ``://``, has empty host and path and is
    allowed. An empty table gives an empty table; columns of the input by those four names are replaced. Any number of
    rules may be given; without any every URL is allowed.
    """
    named = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    place = F.concat("host", "path")
    tokens = sorted({t for r in (*rules, *terms) for t in r.tokens})
    counts = token_counts(named, place, tokens) if tokens else {}
    none = F.lit(None).cast("struct<weight:int,name:string,verdict:string,regex:string>")
    for column, own in (("_own", rules), ("_other", terms)):
        if len(own) > IN_PLAN:
            named = _joined(named, own, counts, place, column)
        else:
            named = named.withColumn(column, _lookup(own, counts, place) if own else none)
    verdict = F.coalesce(F.col("_own.verdict"), F.col("_other.verdict"), F.lit("allow"))
    return named.withColumns({"rule": F.col("_own.name"), "verdict": verdict}).drop("_own", "_other")


def op10_url_filters(spark, sf_dir):
    """Contract query: page_id, host, path, rule and verdict of every row of ``pages``; see ``judge`` for null and odd URLs,
    repeated rows and empty tables."""
    from .common import load

    return judge(load(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = rf"""
with parts as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
rules as (select * from (values ('com/','com','/','allow'), ('example.com/en/','example.com','/en/','block'), ('www.example.com/en/','www.example.com','/en/','allow'),
  ('net/es/','net','/es/','block'), ('net/fr/','net','/fr/','block')) as t(rule, rhost, rpath, verdict)),
fits as (
  select p.page_id, max_by(r.rule, length(r.rule)) as rule, max_by(r.verdict, length(r.rule)) as verdict
  from parts p join rules r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)
  group by p.page_id)
select p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, case when regexp_matches(lower(p.host || p.path), '(^|[^0-9a-z])({"|".join([*TERMS, *(p.replace(" ", "[^0-9a-z]") for p in PHRASES)])})([^0-9a-z]|$)|/[^/]*[.]({"|".join(ENDINGS)})$') then 'block' else 'allow' end) as verdict
from parts p left join fits f on p.page_id = f.page_id
"""
