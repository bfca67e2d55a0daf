"""A property graph derived from the star schema, by integer and string rules alone.

Nations are source files, suppliers contracts, parts functions, customers state
variables and event types events; orders give call sites, reads and writes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.collapse import collapse, collapse_counts, known_drafts, placeholders
from ..schema import CATEGORIES, CALL_SUBKINDS, DRAFT, EDGE, MUTABILITIES, NODE, VISIBILITIES, Graph, conform
from .storage import materialise

CONTRACT_KINDS = ("contract", "interface", "library", "abstract")
GUARDS = tuple(f"Brand#{i}" for i in range(1, 9))


def _pick(index: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


#: Two files whose names are drawn from each other by alias, by namespace, by attachment and by inheritance.
VARIED = {
    "lib.sol": """pragma solidity ^0.8.0;
library L{k} {
    function plus(uint256 a, uint256 b) internal pure returns (uint256) { return a; }
    function plus(uint256 a) internal pure returns (uint256) { return a; }
    function only(uint256 a) internal pure {}
}
function free{k}(uint256 a) pure {}
function twice{k}(uint256 a) pure {}
interface I{k} { function ping(uint256 a) external; }
contract Base{k} {
    uint256 public total;
    constructor(uint256 a) {}
    modifier held(uint256 a) { _; }
    function step(uint256 a) public virtual {}
    function step(address a) public virtual {}
    function step(uint256 a, uint256 b) public virtual {}
}
""",
    "main.sol": """pragma solidity ^0.8.0;
import {L{k} as Lib{k}, Base{k}, I{k}, free{k}} from "./lib.sol";
import "./lib.sol" as Space{k};
contract Main{k} is Base{k} {
    using Lib{k} for uint256;
    using {free{k}} for address;
    function(uint256) internal pointer;
    I{k} peer;
    constructor() Base{k}(1) {}
    function step(uint256 a) public override held(a) {}
    function make() internal returns (I{k}) {}
    function overloads() external { step(1); }
    function narrowed() external { step(1, 2); }
    function unfit() external { step(1, 2, 3); }
    function own() external { this.step(1); }
    function attached(uint256 x) external { x.plus(1); }
    function single(uint256 x) external { x.only(); }
    function listed(address who) external { who.free{k}(); }
    function detached(address who) external { who.nothing(); }
    function low(address who) external { who.delegatecall(""); }
    function aliased(uint256 x) external { Lib{k}.plus(x); }
    function spaced(uint256 x) external { Space{k}.twice{k}(x); }
    function pointed(uint256 x) external { pointer(x); }
    function local(uint256 x) external { function(uint256) internal f; f(x); }
    function loose(uint256 x) external { free{k}(x); }
    function far(uint256 x) external { peer.ping(x); }
    function none(uint256 x) external { peer.pong(x); }
    function chained(uint256 x) external { make().ping(x); }
    function getter(address who) external { Base{k}(who).total(); }
    function built() external { new Base{k}(1); }
    function stored(uint256 x) external { total = x; }
    function hidden(uint256 total) external { total = 1; }
}
""",
}


@dataclass
class Star:
    """The derived tables of one data folder; every part is lazy but for the number of suppliers, the lines of urgent orders and the contracts' orders, which are found once."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.n = self.table("supplier").count()
        self._urgent: DataFrame | None = None
        self.linear: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def files(self) -> DataFrame:
        region = self.table("region").select("r_regionkey", "r_name")
        joined = self.table("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        file = F.concat(F.lower(F.regexp_replace("r_name", " ", "_")), F.lit("/"), F.lower(F.regexp_replace("n_name", " ", "_")), F.lit(".src"))
        return joined.select(F.col("n_nationkey").alias("nation"), "n_name", file.alias("file"))

    def contracts(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").join(self.files(), F.col("s_nationkey") == F.col("nation")).select(
            F.concat(F.lit("c:"), k).alias("id"), k.alias("k"), F.col("s_name").alias("name"), "file", _pick(k % 4, CONTRACT_KINDS).alias("contract_kind"),
            (k % 10 == 0).alias("is_test"), (k % 15 == 0).alias("is_mock"),
        )

    def inherits(self) -> DataFrame:
        """(from_id, to_id, idx): bases in declaration order."""
        k = F.col("s_suppkey")
        bases = F.array_distinct(F.array(F.floor(k / 2), F.floor(k / 3)))
        arcs = self.table("supplier").where("s_suppkey >= 2").select(k.alias("k"), F.posexplode(bases).alias("idx", "b")).where("b != k")
        return arcs.select(F.concat(F.lit("c:"), "k").alias("from_id"), F.concat(F.lit("c:"), "b").alias("to_id"), "idx")

    def functions(self) -> DataFrame:
        k, n = F.col("p_partkey"), F.lit(self.n)
        modifier = (k >= n) & (k < 2 * n) & (k % 3 == 0)
        subkind = F.when(k < n, "constructor").when(modifier, "modifier").otherwise("function")
        body = ~((k % n % 4 == 1) & (F.col("p_size") % 2 == 1))
        return self.table("part").select(
            F.concat(F.lit("f:"), k).alias("id"), k.alias("k"), F.when(modifier, F.col("p_brand")).otherwise(F.col("p_name")).alias("name"), F.concat(F.lit("c:"), k % n).alias("scope"), (k % n).alias("scope_k"),
            subkind.alias("subkind"), _pick(F.col("p_size") % 5, VISIBILITIES).alias("visibility"), _pick(F.col("p_size") % 4, MUTABILITIES).alias("state_mutability"), body.alias("has_body"),
            (F.col("p_size") % 7 == 0).alias("checks_sender"), F.col("p_size"), F.col("p_name"), F.col("p_brand"), F.col("p_type"),
            F.when(body, F.md5(F.concat("p_name", "p_brand", "p_type"))).otherwise("").alias("body_hash"),
        )

    def variables(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(F.concat(F.lit("v:"), k).alias("id"), k.alias("k"), F.col("c_name").alias("name"), F.concat(F.lit("c:"), k % self.n).alias("scope"), F.col("c_mktsegment").alias("type"))

    def events(self) -> DataFrame:
        return self.table("events").select("event_type").distinct().select(F.concat(F.lit("e:"), "event_type").alias("id"), F.col("event_type").alias("name"))

    def modifiers(self) -> DataFrame:
        """(from_id, to_id, name, checks_sender): modifiers that functions apply."""
        f = self.functions().where("subkind = 'function' and p_size % 3 = 0")
        m = F.lit(self.n) + F.col("k") % self.n
        target = F.when(m % 3 == 0, F.concat(F.lit("f:"), m)).otherwise(F.concat(F.lit("?not-found:"), "p_brand"))
        known = self.functions().where("subkind = 'modifier'").select(F.col("id").alias("to_id"), F.col("name").alias("m_name"), F.col("checks_sender").alias("m_checks"))
        applied = f.select(F.col("id").alias("from_id"), target.alias("to_id"), "p_brand").join(known, "to_id", "left")
        return applied.select("from_id", "to_id", F.coalesce("m_name", "p_brand").alias("name"), F.coalesce("m_checks", F.lit(False)).alias("checks_sender"))

    def _lines(self) -> DataFrame:
        if self._urgent is None:
            orders = self.table("orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
            self._urgent = materialise(self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").join(orders, F.col("l_orderkey") == F.col("o_orderkey")))
        return self._urgent

    def _site(self) -> Column:
        return (F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 1000).cast("long").alias("offset")

    def _seq(self) -> Column:
        return (F.col("l_orderkey") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.xxhash64("l_partkey", "l_suppkey") % 1_000_000).alias("seq")

    def calls(self) -> DataFrame:
        """(seq, kind, subkind, from_id, to_id, resolution, offset, callee): call and creates drafts."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        lines = self._lines().withColumn("callee", F.lead("l_partkey").over(order)).where("callee is not null")
        names = self.functions().select(F.col("k").alias("callee"), F.col("p_name").alias("callee_name"))
        lines = lines.join(names, "callee")
        s = F.col("l_suppkey") % 10
        lost, creates = s == 9, F.col("callee") < self.n
        kind = F.when(~lost & creates, "creates").otherwise("calls")
        to = F.when(lost, F.concat(F.lit("?"), _pick(F.col("l_linenumber") % 5, CATEGORIES), F.lit(":"), "callee_name")).when(creates, F.concat(F.lit("c:"), "callee")).otherwise(F.concat(F.lit("f:"), "callee"))
        return lines.select(
            self._seq(), kind.alias("kind"), F.when(kind == "calls", _pick(F.col("l_linenumber") % 6, CALL_SUBKINDS)).alias("subkind"), F.concat(F.lit("f:"), "l_partkey").alias("from_id"), to.alias("to_id"),
            F.when(lost, "unresolved").when(s >= 7, "ambiguous").otherwise("heuristic").alias("resolution"), self._site(), "callee",
        )

    def accesses(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self._lines().where(flag.isin("R", "A")).select(
            self._seq(), F.when(flag == "R", "reads").otherwise("writes").alias("kind"), F.lit(None).cast("string").alias("subkind"), F.concat(F.lit("f:"), "l_partkey").alias("from_id"),
            F.concat(F.lit("v:"), "o_custkey").alias("to_id"), F.lit("heuristic").alias("resolution"), self._site(),
        )

    def emits(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("seq"), F.lit("emits").alias("kind"), F.lit(None).cast("string").alias("subkind"), F.concat(F.lit("f:"), "user_id").alias("from_id"),
            F.concat(F.lit("e:"), "event_type").alias("to_id"), F.lit("heuristic").alias("resolution"), F.col("event_id").alias("offset"),
        )

    def edges(self, *parts: DataFrame) -> DataFrame:
        """Collapsed edges without their sites: keys, counts, weakest resolution, first offset."""
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p, allowMissingColumns=True)
        return collapse_counts(both.withColumn("site", F.struct("offset")))

    def call_edges(self) -> DataFrame:
        return self.edges(self.calls().drop("callee"))

    def sources(self) -> DataFrame:
        """(file, content): the graph's contracts written as Solidity, a file each; function ``f<k>`` adds to variable ``v<k>`` if there is one."""
        n = self.n
        word = F.when(F.col("s_suppkey") % 4 == 1, "interface").when(F.col("s_suppkey") % 4 == 2, "library").when(F.col("s_suppkey") % 4 == 3, "abstract contract").otherwise("contract")
        bases = self.inherits().groupBy(F.regexp_replace("from_id", "c:", "").cast("long").alias("scope_k")).agg(F.concat(F.lit(" is "), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "to_id"))), lambda x: F.regexp_replace(x["to_id"], "c:", "S")), ", ")).alias("bases"))
        var = self.table("customer").select((F.col("c_custkey") % n).alias("scope_k"), F.col("c_custkey").alias("k"), F.concat(F.lit("    uint256 v"), "c_custkey", F.lit(";")).alias("line"), F.lit(0).alias("o"))
        body = F.when(F.col("c_custkey").isNull(), ";").otherwise(F.concat(F.lit(" { v"), "k", F.lit(" += 1; }")))
        f = self.functions().join(self.table("customer").select("c_custkey"), F.col("k") == F.col("c_custkey"), "left")
        vis, mut = F.when(F.col("visibility") != "default", F.concat(F.lit(" "), "visibility")).otherwise(""), F.when(F.col("state_mutability") != "nonpayable", F.concat(F.lit(" "), "state_mutability")).otherwise("")
        f = f.select("scope_k", "k", F.concat(F.lit("    function f"), "k", F.lit("()"), vis, mut, body).alias("line"), F.lit(1).alias("o"))
        lines = var.unionByName(f).groupBy("scope_k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "k", "line"))), lambda x: x["line"]), "\n").alias("body"))
        contracts = self.table("supplier").select(F.col("s_suppkey").alias("scope_k"), word.alias("word"))
        text = F.concat(F.lit("pragma solidity ^0.8.0;\n"), "word", F.lit(" S"), "scope_k", F.coalesce("bases", F.lit("")), F.lit(" {\n"), F.coalesce("body", F.lit("")), F.lit("\n}\n"))
        return contracts.join(bases, "scope_k", "left").join(lines, "scope_k", "left").select(F.concat(F.lit("src/S"), "scope_k", F.lit(".sol")).alias("file"), text.alias("content"))

    def call_sources(self) -> DataFrame:
        """(file, content): a contract per supplier, each on that of half its number, with calls of every shape."""
        k, n = F.col("s_suppkey"), self.n
        base = F.when(k >= 2, F.concat(F.lit(" is C"), F.floor(k / 2))).otherwise("")
        lines = (
            ("    event E{k}(uint256 a);\n    error X{k}();\n    uint256 v{k};\n    C{1} peer;\n    modifier m{k}() {{ _; }}\n    constructor() {{}}\n"),
            ("    function own{k}() internal {{ v{k} += 1; }}\n    function tick() public virtual {{ own{k}(); super.tick(); }}\n    function go{k}() external m{k} {{\n        uint256 w = 1;\n        v{k} = w;\n"),
            ("        this.tick();\n        peer.tick();\n        C{2}(address(0)).tick();\n        new C{3}();\n        emit E{k}(1);\n        if (w > 2) revert X{k}();\n        gone{k}();\n        address(1).call(\"\");\n    }}\n}}\n"),
        )
        parts: list[Column] = []
        for piece in re.split(r"(\{[k123]\})", "".join(lines).replace("{{", "\x01").replace("}}", "\x02")):
            held = re.fullmatch(r"\{([k123])\}", piece)
            parts.append(F.lit(piece.replace("\x01", "{").replace("\x02", "}")) if not held else k.cast("string") if held[1] == "k" else ((k + int(held[1])) % n).cast("string"))
        text = F.concat(F.lit("pragma solidity ^0.8.0;\ncontract C"), k.cast("string"), base, F.lit(" {\n"), *parts)
        return self.table("supplier").select(F.concat(F.lit("lib/C"), k, F.lit(".sol")).alias("file"), text.alias("content"))

    def varied_sources(self) -> DataFrame:
        """(file, content): by supplier a library, an interface and a base in one file, and in another a contract that names them in every way."""
        k = F.col("s_suppkey").cast("string")
        each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(text).alias("text")) for name, text in VARIED.items()))).alias("x")
        return self.table("supplier").select(k.alias("k"), each).select(F.concat(F.lit("p"), "k", F.lit("/"), "x.name").alias("file"), F.replace("x.text", F.lit("{k}"), F.col("k")).alias("content"))

    def graph(self) -> Graph:
        """Nodes and edges with all their columns."""
        files, functions = self.files(), self.functions()
        place = self.contracts().select(F.col("id").alias("scope"), "file")
        src = lambda offset: F.struct(F.col("file"), offset.cast("long").alias("offset"), F.lit(80).cast("long").alias("length"), F.lit(1).alias("line"), F.lit(0).alias("column"))
        access = F.struct(F.array().cast("array<string>").alias("modifiers"), F.lit("none").alias("confidence"))
        flags = F.struct(*(F.col("checks_sender").alias(f) if f == "checksSender" else F.lit(False).alias(f) for f in NODE["flags"].dataType.names))
        parts = [
            files.select(F.col("file").alias("id"), F.lit("SourceUnit").alias("kind"), F.col("n_name").alias("name"), "file", src(F.lit(0)).alias("src")),
            self.contracts().withColumns({"kind": F.lit("Contract"), "src": src(F.col("k") * 100_000)}),
            functions.join(place, "scope").withColumns({"kind": F.lit("Function"), "src": src(F.col("k") * 100), "flags": flags, "access_control": access}),
            self.variables().join(place, "scope").withColumns({"kind": F.lit("StateVariable"), "src": src(F.col("k") * 100 + 90)}),
            self.events().withColumns({"kind": F.lit("Event"), "file": F.lit(None).cast("string")}),
        ]
        nodes = conform(parts[0], NODE)
        for p in parts[1:]:
            nodes = nodes.unionByName(conform(p, NODE))
        drafts = None
        site = F.struct("file", "offset", F.lit(5).cast("long").alias("length"), F.lit(1).alias("line"), F.lit(0).alias("column"))
        where = functions.join(place, "scope").select(F.col("id").alias("from_id"), "file")
        for p in (self.calls(), self.accesses(), self.emits()):
            own = conform(p.join(where, "from_id", "left").withColumn("site", site), DRAFT)
            drafts = own if drafts is None else drafts.unionByName(own)
        home = self.contracts().select(F.col("id").alias("from_id"), "file")
        bases = self.inherits().join(home, "from_id").withColumns({"kind": F.lit("inherits"), "resolution": F.lit("heuristic"), "offset": F.col("idx").cast("long"), "seq": F.col("idx").cast("long"), "linearization_index": F.col("idx")}).withColumn("site", site)
        drafts = drafts.unionByName(conform(bases, DRAFT))
        nodes = nodes.unionByName(conform(placeholders(drafts), NODE))
        return Graph(nodes, conform(collapse(known_drafts(drafts, nodes)), EDGE))
