"""Which declaration a name stands for: methods and properties through classes, composed traits and parents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.operators.scratch import discard, state_of, written


def _offered(own: DataFrame, aliases: DataFrame, uses: DataFrame, exclusions: DataFrame, traits: DataFrame) -> DataFrame:
    """What each type decides by itself, given what traits offer: ``type, name, owner, original, level``; a null owner is a collision or a dead alias.

    Own bodies come first, then aliases, then composed traits less the excluded ones, which must agree on one declaration.
    """
    mine = own.select("type", "name", F.col("type").alias("owner"), F.col("name").alias("original"), F.lit(1).alias("level"))
    through = uses.join(traits.toDF("trait", "name", "owner", "original"), "trait")
    through = through.join(exclusions.select("type", "name", "trait"), ["type", "name", "trait"], "left_anti")
    one = F.min(F.struct("owner", "original")) == F.max(F.struct("owner", "original"))
    agreed = through.groupBy("type", "name").agg(one.alias("one"), F.min(F.struct("owner", "original")).alias("least"))
    pick = lambda c: F.when(F.col("one"), F.col(f"least.{c}")).alias(c)
    composed = agreed.select("type", "name", pick("owner"), pick("original"), F.lit(3).alias("level"))
    named = aliases.where("trait IS NOT NULL").join(traits.toDF("trait", "meant", "owner", "original"), ["trait", "meant"], "left").select("type", "name", "owner", "original", F.lit(2).alias("level"))
    loose = aliases.where("trait IS NULL").join(composed.select("type", F.col("name").alias("meant"), "owner", "original"), ["type", "meant"], "left").select("type", "name", "owner", "original", F.lit(2).alias("level"))
    every = mine.unionByName(named).unionByName(loose).unionByName(composed)
    return every.groupBy("type", "name").agg(F.min(F.struct("level", "owner", "original")).alias("d")).select("type", "name", "d.owner", "d.original", "d.level")


def _climbed(asked: DataFrame, local: DataFrame, types: DataFrame, most_rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """What the nearest class upward that decides says for each ``asked`` (``type, name``), and the scratch tables that may go now. A cycle of parents ends."""
    parents = written(types.where("kind = 'class'").groupBy(F.col("type").alias("at")).agg(F.first("parent", ignorenulls=True).alias("up")), "parents")
    known = local.withColumnRenamed("type", "at")
    found = [c for c in local.columns if c not in ("type", "name")]
    front = written(asked.select("type", "name").distinct().withColumn("at", F.col("type")).withColumn("steps", F.lit(0)), "front")
    done, seen = None, [front]
    for step in range(most_rounds):
        looked = front.join(known, ["at", "name"], "left")
        ended = written(looked.where("level IS NOT NULL").select("type", "name", "steps", *found), "ended")
        done = ended if done is None else done.unionByName(ended)
        moved = looked.where("level IS NULL").join(parents, "at").where("up IS NOT NULL").select("type", "name", F.col("up").alias("at"), F.lit(step + 1).alias("steps"))
        # A chain that comes back to where it was is a cycle and ends.
        been = reduce(DataFrame.union, seen).select("type", "name", "at")
        front = written(moved.join(been, ["type", "name", "at"], "left_anti"), "front")
        seen.append(front)
        if front.isEmpty():
            return done, [*seen, parents]
    raise RuntimeError(f"chains of more than {most_rounds} parents")


def resolve_methods(types: DataFrame, methods: DataFrame, uses: DataFrame, aliases: DataFrame, exclusions: DataFrame, asked: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """The declaration with a body that a call of each ``asked`` (``type, name``) runs: ``type, name, owner, original, steps, outcome``.

    ``types`` has ``type, kind`` (class or trait) ``, parent``; ``methods`` has ``owner, name, abstract``; ``uses`` has ``type, trait``; ``aliases`` has ``type, name, trait``
    (null: any used one) ``, meant``; ``exclusions`` has ``type, name, trait``. An abstract declaration is stepped past. Traits compose traits by the same rules.
    Two traits that offer different declarations collide, and the call stays unresolved, as does a call whose chain of parents ends, leaves the known types or cycles.

    Outcomes: own, alias, trait (``steps`` 0) or inherited; collision; unknown. Repeated inputs count once. Every round is one written front.
    """
    own = methods.where(~F.coalesce("abstract", F.lit(False))).select(F.col("owner").alias("type"), "name").distinct()
    uses, aliases = uses.select("type", "trait").distinct(), aliases.select("type", "name", "trait", "meant").distinct()
    of_trait = types.where("kind = 'trait'").select("type").distinct()
    only = lambda df: df.join(of_trait, "type", "left_semi")
    rows = only(own).select("type", "name", F.col("type").alias("owner"), F.col("name").alias("original"))
    offers = written(rows, "offers")
    nested = only(uses)
    if not nested.isEmpty() or not only(aliases).isEmpty():
        known = state_of(offers)
        for _ in range(most_rounds):
            again = _offered(only(own), only(aliases), nested, only(exclusions), offers).where("owner IS NOT NULL").select("type", "name", "owner", "original")
            before, offers = offers, written(again, "offers")
            discard(before)
            was, known = known, state_of(offers)
            if was == known:
                break
        else:
            raise RuntimeError(f"traits did not settle in {most_rounds} rounds")
    local = written(_offered(own, aliases, uses, exclusions, offers), "local")
    done, left = _climbed(asked, local, types, most_rounds)
    discard(*left, offers)
    kind = F.when(F.col("level").isNull(), "unknown").when(F.col("owner").isNull(), F.when(F.col("level") == 3, "collision").otherwise("unknown")).when(F.col("steps") > 0, "inherited")
    kind = kind.when(F.col("level") == 1, "own").when(F.col("level") == 2, "alias").otherwise("trait")
    return asked.select("type", "name").distinct().join(done, ["type", "name"], "left").select("type", "name", "owner", "original", "steps", kind.alias("outcome"))


def resolve_properties(types: DataFrame, properties: DataFrame, uses: DataFrame, asked: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """The declared type of each ``asked`` property (``type, name``): ``type, name, declared, owner, steps``; nulls where none is declared.

    ``properties`` has ``owner, name, declared``; ``uses`` has ``type, trait, ord``. A type's own declaration comes first, then its traits in order (and theirs), then its
    parent's. Of several own ones the least counts. Cycles end.
    """
    own = properties.groupBy(F.col("owner").alias("type"), "name").agg(F.min("declared").alias("declared")).withColumn("owner", F.col("type")).withColumn("level", F.lit(1))
    own = written(own.select("type", "name", "declared", "owner", "level"), "own")
    uses = written(uses.groupBy("type", "trait").agg(F.min("ord").alias("ord")), "uses")
    local, known = own, state_of(own)
    for _ in range(most_rounds):
        through = uses.join(local.select(F.col("type").alias("trait"), "name", "declared", "owner"), "trait")
        first = through.groupBy("type", "name").agg(F.min(F.struct("ord", "trait", "declared", "owner")).alias("f"))
        composed = first.join(own, ["type", "name"], "left_anti").select("type", "name", F.col("f.declared").alias("declared"), F.col("f.owner").alias("owner"), F.lit(2).alias("level"))
        before, local = local, written(own.unionByName(composed), "properties")
        if before is not own:
            discard(before)
        was, known = known, state_of(local)
        if was == known:
            break
    else:
        raise RuntimeError(f"properties did not settle in {most_rounds} rounds")
    done, left = _climbed(asked, local, types, most_rounds)
    discard(*left, own, uses)
    return asked.select("type", "name").distinct().join(done, ["type", "name"], "left").select("type", "name", "declared", "owner", "steps")


def nearest_base(classes: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``type, steps``: the classes with a base among their ancestors, themselves included, and the steps to the nearest.

    ``classes`` has ``type, parent, base`` (flag). A class stops at its first base; a chain that comes back to where it was, ends or leaves the known classes has none. A repeated
    class counts once (the greatest parent; a base if any row says so). Chains of more than ``most_rounds`` steps are an error.
    """
    known = written(classes.groupBy(F.col("type").alias("at")).agg(F.max("parent").alias("up"), F.coalesce(F.bool_or("base"), F.lit(False)).alias("base")), "classes")
    front = written(known.select(F.col("at").alias("type"), "at", F.lit(0).alias("steps")), "climb")
    seen, found = front.select("type", "at"), None
    for step in range(1, most_rounds + 1):
        met = written(front.join(known, "at"), "met")
        ended = met.where("base").select("type", "steps")
        found = ended if found is None else found.union(ended)
        moved = met.where("NOT base AND up IS NOT NULL").select("type", F.col("up").alias("at"), F.lit(step).alias("steps"))
        front = written(moved.join(seen, ["type", "at"], "left_anti"), "climb")
        if front.isEmpty():
            return found
        seen = seen.union(front.select("type", "at"))
    raise RuntimeError(f"chains of more than {most_rounds} parents")


def resolve_names(names: DataFrame, imports: DataFrame, roots: DataFrame) -> DataFrame:
    """``name, fqn, by``: a name whose head is imported takes the import's meaning, else the longest root that it starts with, else itself.

    ``names`` has ``file, name``; ``imports`` has ``file, alias, meant``; ``roots`` (few declared prefixes) has ``prefix, root``.
    """
    head, rest = F.substring_index("name", "\\", 1), F.expr("substr(name, length(substring_index(name, '\\\\', 1)) + 1)")
    rows = names.select("file", "name", head.alias("alias"), rest.alias("rest")).distinct()
    rows = rows.join(imports.groupBy("file", "alias").agg(F.max("meant").alias("meant")), ["file", "alias"], "left")
    left = rows.where("meant IS NULL").join(roots, F.col("name").startswith(F.col("prefix")), "left")
    left = left.groupBy("file", "name").agg(F.max(F.when(F.col("prefix").isNotNull(), F.struct(F.length("prefix").alias("n"), "prefix", "root"))).alias("r"))
    own = F.when(F.col("r").isNotNull(), F.concat("r.root", F.expr("substr(name, r.n + 1)"))).otherwise(F.col("name"))
    found = left.select("file", "name", own.alias("fqn"), F.when(F.col("r").isNotNull(), "root").otherwise("itself").alias("by"))
    return found.unionByName(rows.where("meant IS NOT NULL").select("file", "name", F.concat("meant", "rest").alias("fqn"), F.lit("import").alias("by")))
