"""From parsed units to edge drafts: imports, scope, inheritance and calls, as joins.

Two tables say what a name means, in a contract's chain and in a file's scope, each
with arrays of candidates by kind. A use of a name is joined to both once, and the
stages of a lookup are a choice among the arrays. Nothing is guessed: several
candidates give several ambiguous drafts, none gives one to a placeholder.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_type_of as base_type
from ..functions.text import normalise_path
from ..plans.storage import materialise
from ..schema import DRAFT, conform
from ..sources import ingest
from . import inherit

# Names the language defines, which lead to no declaration.
BUILTINS = ("require", "assert", "revert", "keccak256", "sha256", "sha3", "ripemd160", "ecrecover", "addmod", "mulmod", "selfdestruct", "suicide", "blockhash", "blobhash", "gasleft", "type", "payable", "unchecked")
BUILTIN_RECEIVERS = ("abi", "msg", "block", "tx", "string", "bytes", "super")
ARRAY_MEMBERS, ADDRESS_VALUES = ("push", "pop", "length"), ("balance", "code", "codehash")
LOW_LEVEL = {"call": "lowlevel", "staticcall": "lowlevel", "callcode": "lowlevel", "delegatecall": "delegatecall", "transfer": "lowlevel", "send": "lowlevel"}
ELEMENTARY, POINTER = r"^(address|bool|string|bytes\d*|u?int\d*|fixed|ufixed)\b", r"^function\s*\("
TEST_BASES = ("Test", "DSTest", "Script", "TestBase")
_CALL = ("call_id", "fn", "file", "scope", "name", "arg_count", "site")
#: A name that so many contracts declare at most is looked for by itself, not along each chain.
FEW = 8
_NO_PARAMS = "array<struct<name:string,type:string,indexed:boolean,storageLocation:string>>"


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@dataclass
class Remappings:
    """Import prefixes, ``context:prefix=target``, longest prefix first, then longest context."""

    rules: list[tuple[str, str, str]]

    @classmethod
    def parse(cls, lines: list[str]) -> "Remappings":
        rules = []
        for line in lines:
            left, eq, target = line.strip().partition("=")
            if eq and left and not left.startswith("#"):
                context, colon, prefix = left.rpartition(":")
                rules.append((context if colon else "", prefix, target))
        return cls(sorted(rules, key=lambda r: (-len(r[1]), -len(r[0]), r)))


def resolve_imports(units: DataFrame, remappings: Remappings | None = None, roots: tuple[str, ...] = ("src", "contracts")) -> DataFrame:
    """(file, path, target, unit_alias, symbols, attempts): the first existing of an import's candidates.

    Candidates in order: relative to the file; the first remapping whose prefix and
    context fit; node_modules; each source root; the project root. target is null if none exists.
    """
    each = units.select("file", F.explode("imports").alias("i")).select("file", "i.path", "i.symbols", "i.unit_alias", F.col("i.src.offset").alias("at")).where("path is not null")
    folder = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "/")).otherwise("")
    mapped = F.lit(None).cast("string")
    for context, prefix, target in reversed((remappings or Remappings([])).rules):
        fits = F.col("path").startswith(prefix) & F.col("file").startswith(context)
        mapped = F.when(fits, F.concat(F.lit(target), F.expr(f"substring(path, {len(prefix) + 1})"))).otherwise(mapped)
    relative = F.col("path").startswith("./") | F.col("path").startswith("../")
    tries = F.when(relative, F.array(F.concat(folder, "path"))).otherwise(F.array_compact(F.array(mapped, F.concat(F.lit("node_modules/"), "path"), *(F.concat(F.lit(f"{r}/"), "path") for r in roots), F.col("path"))))
    tried = each.withColumn("attempts", F.transform(tries, normalise_path))
    known = units.select(F.col("file").alias("target"))
    hit = tried.select("file", "at", F.posexplode("attempts").alias("rank", "target")).join(known, "target").groupBy("file", "at").agg(F.min_by("target", "rank").alias("target"))
    return tried.join(hit, ["file", "at"], "left")


def visible_names(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, name, id): what a file can call by which name: its own, named imports under their alias, all of a bare import."""
    own = symbols.where("scope is null").select("file", "name", "id")
    exports = own.select(F.col("file").alias("target"), F.col("name").alias("origin"), "id")
    found = imports.where("target is not null")
    named = found.select("file", "target", F.explode("symbols").alias("s")).select("file", "target", F.col("s.name").alias("origin"), F.col("s.alias").alias("name")).join(exports, ["target", "origin"]).select("file", "name", "id")
    bare = found.where("size(symbols) = 0 and unit_alias is null").select("file", "target").join(exports, "target").select("file", F.col("origin").alias("name"), "id")
    return union(own, named, bare).distinct()


def some(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


class Resolver:
    def __init__(self, parsed: DataFrame, remappings: Remappings | None = None, roots: tuple[str, ...] = ("src", "contracts")):
        self.units = materialise(ingest.units(parsed))
        self.symbols = s = materialise(ingest.symbols(parsed))
        self.imports = materialise(resolve_imports(self.units, remappings, roots))
        params = F.coalesce("params", F.array().cast(_NO_PARAMS))
        kind = F.when(F.col("subkind") == "modifier", "Modifier").otherwise(F.col("kind"))
        owner = s.where("kind = 'Contract'").select(F.col("id").alias("scope"), F.col("contract_kind").alias("owner_kind"))
        self.all = materialise(s.select("id", kind.alias("kind"), "name", "file", "scope", "subkind", F.array_join(F.transform(params, lambda p: p["type"]), ",").alias("sig"), F.size(params).alias("arity"),
                                        "has_body", "visibility", "type", "is_virtual", "contract_kind").join(owner, "scope", "left"))
        self.contracts = self.all.where("kind = 'Contract'").select("id", "name", "file", "contract_kind")
        seen = visible_names(s, self.imports).join(self.all.drop("name", "file"), "id")
        self.visible = materialise(self._meanings(seen, "file", "v").join(seen.where("kind = 'Contract'").groupBy("file", "name").agg(F.sort_array(F.collect_set(F.struct("id", "contract_kind"))).alias("v_contracts")), ["file", "name"], "left"))
        self.named = materialise(self.contracts.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("id", "contract_kind"))).alias("g_contracts")))
        self.bases = materialise(self._bases())
        arcs = self.bases.where("base is not null").select(F.col("contract").alias("from_id"), F.col("base").alias("to_id"), "idx").distinct()
        self.linear = materialise(inherit.linearise(self.contracts.select("id"), arcs))
        self.chain = self.linear.select(F.col("id").alias("contract"), "certainty", F.posexplode("linearized").alias("at", "scope"))
        self.functions = s.where("kind = 'Function'")
        self.members = materialise(self._members_of(self._asked()))
        self.locals = materialise(self.functions.select(F.col("id").alias("fn"), F.posexplode("locals").alias("i", "l")).groupBy("fn", F.col("l.name").alias("name")).agg(F.min_by("l.type", "i").alias("local_type")))
        self.arms = materialise(self._arms())

    # What names mean

    def _asked(self) -> DataFrame:
        """(contract, name): whose members of which names may be looked up: what functions name, and in all contracts what is called on a contract or value."""
        f, c = self.functions, self.functions.select("scope", F.explode("calls").alias("c"))
        used = [f.select("scope", F.explode("uses.name").alias("name")), f.select("scope", F.explode("refs.name").alias("name")), f.select("scope", F.explode("modifier_names").alias("name"))]
        own = union(*used, c.select("scope", "c.name"), c.select("scope", F.col("c.receiver").alias("name"))).where("scope is not null and name is not null").toDF("contract", "name")
        far = c.where("c.shape in ('cast', 'member')").select("c.name").where("name is not null").distinct()
        owners = self.chain.join(self.all.where("scope is not null").select("scope", "name").distinct().join(far, "name", "left_semi"), "scope").select("contract", "name")
        return materialise(own.unionByName(owners).distinct())

    def _members_of(self, asked: DataFrame) -> DataFrame:
        """The meanings of (contract, name) along the contracts' chains.

        A name that few contracts declare is met by itself, and the place of its owner in the chain
        looked up; another is looked for in each contract of the chain.
        """
        held = self.all.where("scope is not null")
        declared = held.select("scope", "name").distinct()
        few = declared.groupBy("name").agg(F.count("*").alias("_n")).where(F.col("_n") <= FEW).select("name")
        chain = self.chain.select("contract", "scope", F.col("at").alias("depth"))
        rare = asked.join(few, "name", "left_semi").join(declared, "name").join(chain, ["contract", "scope"])
        common = declared.join(few, "name", "left_anti")
        often = asked.join(common.select("name").distinct(), "name", "left_semi").join(chain, "contract").join(common, ["scope", "name"])
        at = rare.select("contract", "name", "scope", "depth").unionByName(often.select("contract", "name", "scope", "depth"))
        row = F.struct("depth", *(c for c in held.columns if c not in ("kind", "name", "sig")))
        best = at.join(held, ["scope", "name"]).groupBy("contract", "kind", "name", "sig").agg(F.min_by(row, "depth").alias("m"))
        return self._meanings(best.select("contract", "kind", "name", "sig", "m.*").drop("scope").withColumnRenamed("contract", "scope"), "scope", "m")

    def _meanings(self, rows: DataFrame, place: str, tag: str) -> DataFrame:
        """(place, name) with arrays of functions (id, arity, lib), modifiers, events and errors, a variable, and whether it is a type."""
        kind = F.col("kind")
        fn = F.when(kind == "Function", F.struct("id", "arity", F.coalesce(F.col("owner_kind") == "library", F.lit(False)).alias("lib")))
        var = F.when(kind == "StateVariable", F.struct("id", "type", F.col("visibility").alias("vis")))
        ids = lambda k: F.sort_array(F.collect_set(F.when(kind == k, F.col("id"))))
        return rows.groupBy(place, "name").agg(
            F.sort_array(F.collect_set(fn)).alias(f"{tag}_fns"), F.min(var).alias(f"{tag}_var"), ids("Modifier").alias(f"{tag}_mods"), ids("Event").alias(f"{tag}_events"), ids("Error").alias(f"{tag}_errors"),
            F.coalesce(F.max(kind.isin("Struct", "Enum", "UserDefinedValueType")), F.lit(False)).alias(f"{tag}_type"),
        )

    def mean(self, rows: DataFrame, name: str = "name", tables: str = "mv") -> DataFrame:
        """``rows`` joined to what ``name`` means in their scope and file."""
        out = rows
        if "m" in tables:
            out = out.join(self.members.withColumnRenamed("name", name), ["scope", name], "left")
        if "v" in tables:
            out = out.join(self.visible.withColumnRenamed("name", name), ["file", name], "left")
        return out

    def with_contracts(self, rows: DataFrame, name: str) -> DataFrame:
        """Adds contracts: those of the name visible in the file, else all of that name."""
        seen = self.visible.select("file", F.col("name").alias(name), F.col("v_contracts").alias("_v"))
        far = self.named.select(F.col("name").alias(name), F.col("g_contracts").alias("_g"))
        return rows.join(seen, ["file", name], "left").join(far, name, "left").withColumn("contracts", F.when(some("_v"), F.col("_v")).otherwise(F.col("_g"))).drop("_v", "_g")

    def _bases(self) -> DataFrame:
        """(contract, file, base_name, idx, base, n, site): bases by name, n candidates each; base is null if none."""
        each = self.symbols.where("kind = 'Contract'").select(F.col("id").alias("contract"), "file", self.site(), F.posexplode("base_names").alias("idx", "base_name"))
        out = self.with_contracts(each, "base_name").withColumn("n", F.coalesce(F.size("contracts"), F.lit(0)))
        return out.select("contract", "file", "base_name", "idx", "site", "n", F.explode_outer("contracts").alias("c")).withColumn("base", F.col("c.id")).drop("c")

    def _arms(self) -> DataFrame:
        """(to_id, targets, open): implementations of functions in derived contracts; open if virtual or an interface's."""
        f = self.all.where("kind = 'Function' and scope is not null")
        again = f.groupBy("name", "sig").agg(F.count_distinct("scope").alias("_n")).where("_n > 1")  # others have no second implementation
        f = materialise(f.join(again.select("name", "sig"), ["name", "sig"], "left_semi"))
        body = f.where("has_body").select(F.col("scope").alias("derived"), "name", "sig", F.col("id").alias("t"))
        derived = inherit.derived_from(self.linear).select(F.col("id").alias("scope"), "derived")
        open_ = F.coalesce(F.col("is_virtual") | (F.col("owner_kind") == "interface"), F.lit(False))
        return f.join(derived, "scope").join(body, ["derived", "name", "sig"]).groupBy(F.col("id").alias("to_id")).agg(F.sort_array(F.collect_set("t")).alias("targets"), F.max(open_).alias("open"))

    @staticmethod
    def site(src: str = "src") -> Column:
        return F.struct("file", F.col(f"{src}.offset").alias("offset"), F.col(f"{src}.length").alias("length"), F.col(f"{src}.line").alias("line"), F.col(f"{src}.column").alias("column")).alias("site")

    # Drafts

    @staticmethod
    def emit(rows: DataFrame, kind: Column | str, candidates: Column, reason: str, subkind: Column | str | None = None) -> DataFrame:
        """Drafts to an array of ids; more than one makes them ambiguous."""
        n = F.size("_c")
        out = rows.withColumn("_c", candidates).where(n > 0)
        return out.select(
            F.col("fn").alias("from_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (subkind if isinstance(subkind, Column) else F.lit(subkind).cast("string")).alias("subkind"), F.explode("_c").alias("to_id"), "site",
            F.when(n > 1, "ambiguous").otherwise("heuristic").alias("resolution"), F.when(n > 1, F.concat(n.cast("string"), F.lit(f" {reason}"))).alias("reason"),
            *(c for c in ("cross_trust_boundary", "fan_out") if c in rows.columns),
        )

    @staticmethod
    def lost(rows: DataFrame, kind: Column | str, category: str, reason: Column | str, subkind: Column | str | None = None) -> DataFrame:
        return rows.select(
            F.col("fn").alias("from_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (subkind if isinstance(subkind, Column) else F.lit(subkind).cast("string")).alias("subkind"),
            F.concat(F.lit(f"?{category}:"), "name").alias("to_id"), "site", F.lit("unresolved").alias("resolution"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        )

    @staticmethod
    def by_arity(c: str) -> Column:
        """Of candidates those that take as many arguments; all if none does."""
        fits = F.filter(c, lambda x: x["arity"] == F.col("arg_count"))
        return F.when(F.size(fits) > 0, fits).otherwise(F.col(c))

    @staticmethod
    def ids(c: Column) -> Column:
        return F.transform(c, lambda x: x["id"])

    def declares(self) -> DataFrame:
        return self.symbols.select(F.coalesce("scope", "file").alias("from_id"), F.col("id").alias("to_id"), self.site(), F.lit("declares").alias("kind"), F.lit("heuristic").alias("resolution"))

    def inherits(self) -> DataFrame:
        order = self.chain.select(F.col("contract"), F.col("scope").alias("base"), F.col("at").alias("linearization_index"))
        rows = self.bases.join(order, ["contract", "base"], "left").withColumnsRenamed({"contract": "fn", "base_name": "name"})
        found = rows.where("base is not null").select(F.col("fn").alias("from_id"), F.lit("inherits").alias("kind"), F.col("base").alias("to_id"), "site", "linearization_index", F.when(F.col("n") > 1, "ambiguous").otherwise("heuristic").alias("resolution"), F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" contracts named "), "name")).alias("reason"))
        return union(found, self.lost(rows.where("base is null"), "inherits", "not-found", "no contract of that name in scope or project"))

    def overrides(self) -> DataFrame:
        members = self.all.where("kind in ('Function', 'Modifier') and scope is not null").withColumns({"sig": F.concat("kind", F.lit("|"), "sig"), "kind": F.lit("Function")})
        at = self.symbols.select(F.col("id").alias("from_id"), self.site())
        return inherit.overrides(self.linear, members).join(at, "from_id").withColumn("resolution", F.lit("heuristic"))

    def modifiers(self) -> DataFrame:
        each = self.functions.select(F.col("id").alias("fn"), "file", "scope", self.site(), F.explode("modifier_names").alias("name"))
        rows = self.with_contracts(self.mean(each, tables="m"), "name").join(self.linear.select(F.col("id").alias("scope"), "linearized"), "scope", "left")
        builders = self.all.where("subkind = 'constructor'").groupBy(F.col("scope").alias("b")).agg(F.min("id").alias("ctor"))
        rows = materialise(rows.withColumn("base", F.filter("contracts", lambda c: F.array_contains("linearized", c["id"]))).withColumn("b", F.col("base")[0]["id"]).join(builders, "b", "left"))
        is_base = some("base")
        return union(
            self.emit(rows.where(some("m_mods")), "modifiedBy", F.col("m_mods"), "modifiers of that name in the chain"),
            self.emit(rows.where(~some("m_mods") & is_base & F.col("ctor").isNotNull()), "calls", F.array("ctor"), "base constructors", "internal"),
            self.lost(rows.where(~some("m_mods") & ~is_base), "modifiedBy", "not-found", "no modifier of that name in the chain"),
        )

    def accesses(self) -> DataFrame:
        each = self.functions.select(F.col("id").alias("fn"), "file", "scope", F.explode("uses").alias("u")).select("fn", "file", "scope", F.col("u.name").alias("name"), F.col("u.write").alias("write"), self.site("u.src"))
        rows = self.mean(each.join(self.locals.select("fn", "name"), ["fn", "name"], "left_anti")).withColumn("to_id", F.coalesce("m_var.id", "v_var.id")).where("to_id is not null")
        return rows.select(F.col("fn").alias("from_id"), F.when(F.col("write"), "writes").otherwise("reads").alias("kind"), "to_id", "site", F.lit("heuristic").alias("resolution"))

    def references(self) -> DataFrame:
        each = self.functions.select(F.col("id").alias("fn"), "file", "scope", F.explode("refs").alias("r")).select("fn", "file", "scope", F.col("r.kind").alias("relation"), F.col("r.name").alias("name"), self.site("r.src"))
        event = F.col("relation") == "emits"
        own, far = F.when(event, F.col("m_events")).otherwise(F.col("m_errors")), F.when(event, F.col("v_events")).otherwise(F.col("v_errors"))
        rows = materialise(self.mean(each).withColumns({"own": own, "far": far}).withColumn("found", F.when(some("own"), F.col("own")).otherwise(F.col("far"))).select("fn", "name", "relation", "site", "found"))
        return union(self.emit(rows, F.col("relation"), F.col("found"), "declarations of that name in scope"), self.lost(rows.where(~some("found")), F.col("relation"), "not-found", "not declared in the chain or the file's scope"))

    # Calls

    def calls(self) -> DataFrame:
        c = self.functions.select(F.col("id").alias("fn"), "file", "scope", F.posexplode("calls").alias("i", "c"))
        c = materialise(c.select(F.concat_ws("#", "fn", "i").alias("call_id"), "fn", "file", "scope", F.col("c.shape").alias("shape"), F.col("c.name").alias("name"), F.col("c.receiver").alias("receiver"), F.col("c.arg_count").alias("arg_count"), self.site("c.src")))
        cast, member = self._casts(c.where("shape = 'cast'")), self._members(c.where("shape = 'member'"))
        every = union(
            self._new(c.where("shape = 'new'")), self._bare(c.where("shape = 'bare'")), self._super(c.where("shape = 'super'")), self._this(c.where("shape = 'this'")), self._expression(c.where("shape = 'expression'")),
            cast[0], member[0], self._on_contracts(union(cast[1], member[1])), self._on_elementary(union(cast[2], member[2])),
        )
        every = every.join(self.arms, "to_id", "left")
        use = (F.col("fan_out") == "all") | ((F.col("fan_out") == "open") & F.col("open"))
        return every.withColumn("targets", F.when(use, F.col("targets"))).drop("open", "fan_out")

    def _new(self, c: DataFrame) -> DataFrame:
        c = c.where(~F.col("name").rlike(ELEMENTARY) & ~F.col("name").contains("[")).withColumn("plain", base_type(F.col("name")))
        rows = self.with_contracts(c, "plain")
        return union(self.emit(rows, "creates", self.ids(F.col("contracts")), "contracts of that name"), self.lost(rows.where(~some("contracts")), "creates", "not-found", "no contract of that type in scope"))

    def _bare(self, c: DataFrame) -> DataFrame:
        rows = self.mean(c.where(~F.col("name").isin(*BUILTINS))).join(self.locals, ["fn", "name"], "left").withColumn("fns", F.when(some("m_fns"), F.col("m_fns")).otherwise(F.col("v_fns")))
        pointer = F.coalesce(F.col("m_var.type").rlike(POINTER), F.lit(False))
        a_type = F.coalesce("m_type", F.lit(False)) | F.coalesce("v_type", F.lit(False)) | some("v_contracts")
        route = F.when(F.col("local_type").isNotNull(), "local").when(some("fns"), "found").when(pointer, "pointer").when(~a_type, "lost")
        rows = materialise(rows.withColumns({"route": route, "chosen": self.by_arity("fns"), "fan_out": F.lit("all")}).select(*_CALL, "route", "chosen", "local_type", "fan_out"))
        sub = F.when(F.col("chosen")[0]["lib"], "library").otherwise("internal")
        why = F.when(F.col("route") == "pointer", "call through a function pointer").when(F.col("local_type").rlike(POINTER), "call through a function pointer").otherwise("call through a local value")
        return union(
            self.emit(rows.where("route = 'found'"), "calls", self.ids(F.col("chosen")), "overloads; their argument types would have to be inferred", sub),
            self.lost(rows.where("route in ('local', 'pointer')"), "calls", "function-pointer", why, "internal"),
            self.lost(rows.where("route = 'lost'"), "calls", "not-found", "no function of that name in the contract, its bases or the file's scope", "internal"),
        )

    def _super(self, c: DataFrame) -> DataFrame:
        up = self.chain.where("at > 0").select(F.col("contract").alias("scope"), "certainty", "at", F.col("scope").alias("base"))
        f = self.all.where("kind = 'Function' and has_body").select(F.col("scope").alias("base"), "name", F.struct("id", "arity").alias("f"))
        hit = c.join(up, "scope").join(f, ["base", "name"]).groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("at", "f"))).alias("x"), F.first("certainty").alias("certainty"))
        near = F.filter("x", lambda y: y["at"] == F.col("x")[0]["at"])
        rows = c.join(hit, "call_id", "left").withColumn("sure", F.transform(near, lambda y: y["f"])).withColumn("chosen", F.when(F.col("certainty") == "ambiguous", F.transform("x", lambda y: y["f"])).otherwise(self.by_arity("sure")))
        rows = materialise(rows)
        sure = self.emit(rows.where("certainty = 'certain'"), "calls", self.ids(F.col("chosen")), "implementations reachable through super", "super")
        maybe = self.emit(rows.where("certainty = 'ambiguous'"), "calls", self.ids(F.col("chosen")), "bases", "super").withColumns({"resolution": F.lit("ambiguous"), "reason": F.lit("the chain has no certain linear order")})
        return union(sure, maybe, self.lost(rows.where(~some("chosen")), "calls", "not-found", "no implementation of that name in the bases", "super"))

    def _this(self, c: DataFrame) -> DataFrame:
        rows = self.mean(c, tables="m").withColumn("chosen", self.by_arity("m_fns"))
        return union(self.emit(rows, "calls", self.ids(F.col("chosen")), "overloads of that name", "external"), self.lost(rows.where(~some("m_fns")), "calls", "not-found", "no such function on this contract", "external"))

    def _expression(self, c: DataFrame) -> DataFrame:
        tail = F.regexp_extract(F.coalesce("receiver", F.lit("")), r"([A-Za-z_$][\w$]*)\s*$", 1)
        c = c.where(~tail.isin(*BUILTIN_RECEIVERS) & ~F.col("name").isin(*ARRAY_MEMBERS))
        return self.lost(c, "calls", "dynamic-receiver", "the receiver is an expression without a declared type", self._low("external"))

    @staticmethod
    def _low(other: str) -> Column:
        out = F.lit(other)
        for name, sub in LOW_LEVEL.items():
            out = F.when(F.col("name") == name, sub).otherwise(out)
        return out

    def _casts(self, c: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(drafts, calls on contracts, calls on values of a type)."""
        rows = self.with_contracts(c.withColumn("type", base_type(F.col("receiver"))), "type").withColumn("default_sub", F.lit("external"))
        simple = F.col("receiver").rlike(ELEMENTARY)
        gone = self.lost(rows.where(~simple & ~some("contracts")), "calls", "not-found", F.concat(F.lit("cast to unknown type "), "receiver"), "external")
        return gone, rows.where(~simple & some("contracts")).select(*_CALL, "contracts", "default_sub"), rows.where(simple).select(*_CALL, "type")

    def _members(self, c: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The same of calls on a name."""
        space = self.imports.where("unit_alias is not null and target is not null").groupBy("file", F.col("unit_alias").alias("receiver")).agg(F.min("target").alias("target"))
        exported = self.all.where("scope is null and kind = 'Function'").groupBy(F.col("file").alias("target"), "name").agg(F.sort_array(F.collect_set(F.struct("id", "arity"))).alias("ns_fns"))
        rows = c.where(~F.col("receiver").isin(*BUILTIN_RECEIVERS)).join(space, ["file", "receiver"], "left").join(exported, ["target", "name"], "left")
        rows = self.mean(rows, "receiver").join(self.locals.withColumnRenamed("name", "receiver"), ["fn", "receiver"], "left")
        rows = rows.withColumns({"declared": F.coalesce("local_type", "m_var.type", "v_var.type"), "a_type": F.coalesce("m_type", F.lit(False)) | F.coalesce("v_type", F.lit(False))})
        rows = self.with_contracts(rows.select(*_CALL, "receiver", "ns_fns", "declared", "a_type"), "receiver").withColumnRenamed("contracts", "direct")
        rows = self.with_contracts(rows.withColumn("type", base_type(F.col("declared"))), "type")
        simple = F.coalesce(F.col("declared").rlike(ELEMENTARY), F.lit(False))
        route = (
            F.when(some("ns_fns"), "space").when(F.col("a_type"), "none").when(F.col("declared").isNull() & some("direct"), "direct").when(F.col("declared").isNull(), "lost").when(simple, "simple")
            .when(some("contracts"), "typed").when(F.col("name").isin(*ARRAY_MEMBERS), "none").otherwise("simple")
        )
        rows = materialise(rows.withColumn("route", route))
        drafts = union(
            self.emit(rows.where("route = 'space'"), "calls", self.ids(F.col("ns_fns")), "namespace members", "internal"),
            self.lost(rows.where("route = 'lost'"), "calls", "dynamic-receiver", F.concat(F.lit("receiver "), "receiver", F.lit(" has no declared type in scope")), "external"),
        )
        direct = rows.where("route = 'direct'").withColumn("default_sub", F.when(F.col("direct")[0]["contract_kind"] == "library", "library").otherwise("external")).select(*_CALL, F.col("direct").alias("contracts"), "default_sub")
        typed = rows.where("route = 'typed'").select(*_CALL, "contracts", F.lit("external").alias("default_sub"))
        return drafts, union(direct, typed), rows.where("route = 'simple'").select(*_CALL, "type")

    def _on_contracts(self, rows: DataFrame) -> DataFrame:
        """Functions of the contracts, else their public variables."""
        m = self.members.select(F.col("scope").alias("contract"), "name", "m_fns", "m_var")
        each = rows.select(*_CALL, "default_sub", F.explode("contracts").alias("k")).withColumn("contract", F.col("k.id")).join(m, ["contract", "name"], "left")
        first = [F.first(c).alias(c) for c in (*_CALL[1:], "default_sub")]
        none = F.array().cast("array<struct<id:string,arity:int,lib:boolean>>")
        by = each.groupBy("call_id").agg(
            *first, F.array_distinct(F.flatten(F.collect_list(F.coalesce("m_fns", none)))).alias("fns"), F.sort_array(F.collect_set(F.when(F.col("m_var.vis") == "public", F.col("m_var.id")))).alias("getters"),
            F.max((F.col("k.contract_kind") == "interface") & some("m_fns")).alias("cross_trust_boundary"),
        )
        by = materialise(by.withColumns({"chosen": F.sort_array(self.by_arity("fns")), "fan_out": F.lit("open")}))
        sub = F.when(F.col("chosen")[0]["lib"], "library").otherwise(F.col("default_sub"))
        rest = by.where(~some("fns") & ~some("getters") & ~F.col("name").isin(*ARRAY_MEMBERS))
        return union(
            self.emit(by, "calls", self.ids(F.col("chosen")), "candidates of that name", sub),
            self.emit(by.where(~some("fns")).drop("cross_trust_boundary", "fan_out"), "calls", F.col("getters"), "public variables of that name", "external"),
            self.lost(rest, "calls", "not-found", "no such member on the contract", F.col("default_sub")),
        )

    def _on_elementary(self, rows: DataFrame) -> DataFrame:
        """Functions attached to the type, else members that every value has."""
        rows = materialise(rows)
        using = self.units.select("file", F.explode("using").alias("u")).select("file", F.col("u.scope").alias("scope"), F.col("u.library").alias("library"), F.col("u.functions").alias("listed"), base_type(F.col("u.type")).alias("for_type")).where("scope is not null")
        using = self.with_contracts(using, "library").select("scope", "listed", "for_type", F.coalesce(self.ids(F.col("contracts")), F.array().cast("array<string>")).alias("libs"))
        fits = rows.join(using, "scope").where("for_type is null or for_type = type")
        lib = fits.select("call_id", "name", F.explode("libs").alias("lib")).join(self.members.select(F.col("scope").alias("lib"), "name", "m_fns"), ["lib", "name"]).select("call_id", F.explode(self.ids(F.col("m_fns"))).alias("id"))
        free = fits.where(F.array_contains("listed", F.col("name"))).join(self.visible.select("file", "name", "v_fns"), ["file", "name"]).select("call_id", F.explode(self.ids(F.col("v_fns"))).alias("id"))
        attached = union(lib, free).groupBy("call_id").agg(F.sort_array(F.collect_set("id")).alias("attached"))
        rows = materialise(rows.join(attached, "call_id", "left"))
        rest = rows.where(~some("attached") & ~F.col("name").isin(*ARRAY_MEMBERS, *ADDRESS_VALUES))
        return union(
            self.emit(rows, "calls", F.col("attached"), "attached functions of that name", "library"),
            self.lost(rest.where(F.col("name").isin(*LOW_LEVEL)), "calls", "low-level", F.concat("name", F.lit(" on "), "type", F.lit(": the target is known at run time only")), self._low("lowlevel")),
            self.lost(rest.where(~F.col("name").isin(*LOW_LEVEL)), "calls", "unattached-member", F.concat(F.lit("no function "), "name", F.lit(" attached to "), "type"), "external"),
        )

    def drafts(self) -> DataFrame:
        """All drafts, numbered by file and place."""
        parts = (self.declares, self.inherits, self.overrides, self.modifiers, self.accesses, self.references, self.calls)
        with ThreadPoolExecutor(len(parts)) as pool:  # they only share tables that are written
            every = union(*pool.map(lambda part: materialise(part()), parts))
        numbered = every.withColumn("_f", F.col("site.file")).join(self._file_numbers(), "_f").withColumn("seq", F.shiftleft("_n", 31) + F.col("site.offset"))
        return materialise(conform(numbered, DRAFT))

    def _file_numbers(self) -> DataFrame:
        """(_f, _n): files numbered in order, by ranges of files and the counts of the ranges before."""
        ranges = self.units.select(F.col("file").alias("_f")).repartitionByRange("_f").sortWithinPartitions("_f")
        inside = F.monotonically_increasing_id()
        rows = materialise(ranges.select("_f", F.shiftright(inside, 33).alias("_p"), inside.bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
        counts = rows.groupBy("_p").agg(F.count("*").alias("_c"))  # a row per range
        before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.join(F.broadcast(counts.select("_p", before.alias("_b"))), "_p").select("_f", (F.col("_b") + F.col("_i")).alias("_n"))
