"""An interactive shell: build, load, print, find, suggest, help, exit, quit."""

from __future__ import annotations

import shlex
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.functions.rankers import RANKERS
from textloom.functions.text import html_text, html_title
from textloom.operators import fuzzy, retrieve, snippets
from textloom.operators.boolean import words
from textloom.operators.index import Index, build_index, print_term, reconstruct_tokens
from textloom.sources import crawl, storage
from textloom.sources.fetch import Fetcher, fetched

HELP = "build START TO | build PAGES TO | load FROM | print WORD | find [--ranker NAME] [--explain] [--snippet] WORDS | suggest PREFIX | help | exit | quit"


@dataclass
class Flags:
    ranker: str = "tfidf"
    explain: bool = False
    snippet: bool = False
    words: list[str] = field(default_factory=list)


def flags(args: list[str]) -> Flags:
    """Flags may stand anywhere; --ranker without a name is a word."""
    out, k = Flags(), 0
    while k < len(args):
        if args[k] == "--ranker" and k + 1 < len(args):
            k += 1
            if args[k] not in RANKERS:
                raise ValueError(f"unknown ranker {args[k]}; there are {', '.join(RANKERS)}")
            out.ranker = args[k]
        elif args[k] == "--explain":
            out.explain = True
        elif args[k] == "--snippet":
            out.snippet = True
        else:
            out.words.append(args[k])
        k += 1
    return out


class Shell:
    """top_k: results shown at most, all by default. fetcher: asks for pages when a site is built."""

    def __init__(self, spark: SparkSession, say: Callable[[str], None] = print, top_k: int | None = None, fetcher: Fetcher | None = None):
        self.spark, self.say, self.top_k, self.fetcher = spark, say, top_k, fetcher
        self.index: Index | None = None

    def run(self, lines: Iterable[str]) -> None:
        for line in lines:
            if not self.dispatch(line):
                break

    def dispatch(self, line: str) -> bool:
        """Whether to go on."""
        try:
            args = shlex.split(line)
        except ValueError as e:
            self.say(f"parse error: {e}")
            return True
        if not args:
            return True
        name, rest = args[0].lower(), args[1:]
        if name in ("exit", "quit"):
            return False
        if name not in ("build", "load", "print", "find", "suggest", "help"):
            self.say(f"unknown command {name}; try help")
        elif name in ("print", "find", "suggest") and self.index is None:
            self.say("no index: build or load one first")
        else:
            try:
                getattr(self, f"do_{name}")(rest)
            except (storage.StorageError, crawl.CrawlError, AnalysisException, ValueError) as e:
                self.say(f"error: {e}")
        return True

    def do_help(self, args: list[str]) -> None:
        self.say(HELP)

    def do_build(self, args: list[str]) -> None:
        if len(args) != 2:
            raise ValueError("build needs a start address, or a Parquet table of pages (page_id, url, html), and a folder")
        if "://" in args[0] and args[0].split("://")[0] in ("http", "https"):
            pages = fetched(self.spark, args[0], fetcher=self.fetcher)
            self.say(f"fetched {pages.count()} pages")
            first = crawl.crawl(pages.select("url", "html"), args[0])  # of equal texts the one reached first
            numbered = pages.select("page_id", crawl.url_normalised(F.col("url")).alias("url"))
            rows = first.join(numbered, "url").select(F.col("page_id").alias("doc_id"), "url", "title", "text")
        else:
            rows = self.spark.read.parquet(args[0]).select(F.col("page_id").alias("doc_id"), "url", html_title(F.col("html")).alias("title"), html_text(F.col("html")).alias("text"))
        storage.save(build_index(rows), args[1])
        self.do_load(args[1:])

    def do_load(self, args: list[str]) -> None:
        if len(args) != 1:
            raise ValueError("load needs a folder, or a JSON file of the older form")
        self.index = storage.load_json(self.spark, args[0]) if args[0].endswith(".json") else storage.load(self.spark, args[0])
        m = self.index.meta.first()
        self.say(f"{m['num_docs']} documents, {m['num_terms']} terms")

    def do_print(self, args: list[str]) -> None:
        own = words(" ".join(args))[:1]
        if not own:
            return self.say("empty term")
        rows = print_term(self.index, own[0]).orderBy("url").collect()
        if not rows:
            return self.say(f"term '{own[0]}' not found in index")
        self.say(f"{own[0]}: df={rows[0]['df']} cf={rows[0]['cf']}")
        for r in rows:
            self.say(f"  {r['url']} tf={r['tf']} positions={list(r['positions'])}")

    def do_find(self, args: list[str]) -> None:
        f = flags(args)
        text = " ".join(f.words)
        found = retrieve.find(self.index, text, ranker=f.ranker, top_k=self.top_k, explain=f.explain)
        rows = found.collect()
        if not rows:
            self.say("no results")
            return self.fall_back(text)
        cut = {}
        if f.snippet:
            own = reconstruct_tokens(self.index.postings.join(F.broadcast(found.select("doc_id")), "doc_id", "left_semi"))
            cut = {r["doc_id"]: r["snippet"] for r in snippets.snippets(own, words(text)).collect()}
        for k, r in enumerate(rows, 1):
            self.say(f"{k}. {r['url']} {r['title']} ({r['score']:.6f})")
            for b in r["breakdown"] if f.explain else []:
                self.say(f"     {b['term']} tf={b['tf']} df={b['df']} +{b['contribution']:.6f}")
            if r["doc_id"] in cut:
                self.say(f"     {cut[r['doc_id']]}")

    def fall_back(self, text: str) -> None:
        """Suggestions for the first word that the index doesn't know."""
        own = list(dict.fromkeys(words(text)))
        known = {r["term"] for r in self.index.terms.where(F.col("term").isin(own)).select("term").collect()} if own else set()
        for w in own:
            if w not in known:
                near = [r["term"] for r in fuzzy.suggest(self.index.terms, w).collect()]
                if near:
                    self.say(f"did you mean: {', '.join(near)}?")
                return

    def do_suggest(self, args: list[str]) -> None:
        own = words(" ".join(args))[:1]
        if not own:
            return self.say("empty prefix")
        rows = fuzzy.autocomplete(self.index.terms, own[0], 10).collect()
        if not rows:
            self.say(f"no terms begin with '{own[0]}'")
        for r in rows:
            self.say(f"{r['term']} ({r['cf']})")


def main() -> None:
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    Shell(spark).run(iter(lambda: input("> "), None) if sys.stdin.isatty() else (x.rstrip("\n") for x in sys.stdin))


if __name__ == "__main__":
    main()
