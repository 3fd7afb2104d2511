"""Libraries of expected sequences, and the search for the nearest ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.errors import LibraryError, OptionError
from readweave.functions.exprs import CENTER, OVERLAP, PARTIAL3, PARTIAL5, hamming, hamming_packed, packed_bases
from readweave.operators.spec import LibrarySpec
from readweave.session import with_place

METRICS = ("exact", "hamming", "levenshtein", "bounded-levenshtein")
#: Estimated bytes of a library up to which its seeds are broadcast; larger ones are joined by a shuffle.
BROADCAST = 2 << 20
FULL, HEAD, TAIL = "full", "head", "tail"


def read_library_tsv(spark: SparkSession, path: str) -> DataFrame:
    """One library file: tab-separated with header and # comments, every column text and trimmed; ragged rows fail."""
    return spark.read.csv(
        path, sep="\t", header=True, comment="#", quote='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
        inferSchema=False, mode="FAILFAST", enforceSchema=False,
    )


def with_member_ids(members: DataFrame, number: int) -> DataFrame:
    """Members with ``_id``; without such a column they are named lib<file>_<row>, both from 0, in file order."""
    if "_id" in members.columns:
        return members
    placed = with_place(members, "__place")
    return placed.withColumn("_id", F.concat(F.lit(f"lib{number}_"), (F.col("__place") - 1).cast("string"))).drop("__place")


def compile_library(spec: LibrarySpec, *files: DataFrame, check_ids: bool = True) -> DataFrame:
    """``sublib, region_id, seq, ids``: one row per distinct sequence of a region, with its sorted member ids.

    Checks that columns are variable regions of the specification, that a region belongs to one
    file only, that ids are unique and ``_id`` is no region. The check of ids runs a job; it can
    be left out where they are known to be unique.
    """
    known = [r.id for r in spec.variable]
    if "_id" in known:
        raise LibraryError("'_id' cannot be a region")
    seen: dict[str, int] = {}
    out = None
    for number, raw in enumerate(files):
        regions = [c for c in raw.columns if c != "_id"]
        for c in regions:
            if c not in known:
                raise LibraryError(f"library column {c!r} is not a variable region of the specification")
            if c in seen:
                raise LibraryError(f"region {c!r} is in more than one library")
            seen[c] = number
        members = with_member_ids(raw, number)
        if check_ids and members.groupBy("_id").count().where("count > 1").limit(1).count():
            raise LibraryError(f"library {number} has repeated ids")
        long = members.select("_id", F.explode(F.array(*[F.struct(F.lit(c).alias("region_id"), F.col(c).alias("seq")) for c in regions])).alias("x"))
        part = (
            long.select("_id", "x.*").where(F.col("seq").isNotNull()).groupBy("region_id", "seq")
            .agg(F.array_sort(F.collect_set("_id")).alias("ids"))
            .select(F.lit(number).alias("sublib"), "region_id", "seq", "ids")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise LibraryError("no library given")
    return out.select(F.col("sublib").alias("sublib", metadata={"homes": seen}), "region_id", "seq", "ids")


def homes_of(library: DataFrame) -> dict[str, int]:
    """The number of the file that holds each region; told by the compiled table's metadata, else looked up (one row per region)."""
    known = library.schema["sublib"].metadata.get("homes")
    if known is not None:
        return known
    return {r["region_id"]: r["sublib"] for r in library.select("region_id", "sublib").dropDuplicates().collect()}


def _length_fits(lev: bool) -> Column:
    """Whether a library sequence of length m can be within ``limit`` of a probe of length n."""
    m, n, limit = F.length("hit"), F.col("n"), F.col("limit")
    if lev:
        return F.when(F.col("anchor") == FULL, F.abs(m - n) <= limit).otherwise(n - m <= limit)  # what is shown is never longer than the probe
    return F.when(F.col("anchor") == FULL, m == n).otherwise(m >= n)


def lookup(probes: DataFrame, library: DataFrame, metric: str, max_distance: int, distances: dict[str, int] | None = None) -> DataFrame:
    """Nearest library sequences of each probe (``region_id, seq, anchor``): ``distance, found``, and of ``found`` the ``hits`` and ``ids``.

    An equal sequence is the answer whatever the anchor. Else all sequences at the least
    distance not above the region's maximum are hits, compared whole (``full``) or by the
    start (``head``) or the end (``tail``) as long as the probe. ``found`` is an array of (hit, ids)
    sorted by hit; ``ids`` are the members that have any of them. Probes without a hit do not
    appear. Null probes match nothing.

    Probes and library meet by pigeonhole seeds: of limit + 1 chunks of what a library sequence
    shows, one is untouched by at most ``limit`` edits and stands in the probe at the same place
    (Hamming) or at most ``limit`` places off (Levenshtein). Equal sequences meet as a whole,
    those too short to be cut by length alone. Everything is one lazy plan over one read of the
    probes' distinct rows.
    """
    if metric not in METRICS:
        raise OptionError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    lev, limits = metric.endswith("levenshtein"), {} if metric == "exact" else distances or {}
    most = 0 if metric == "exact" else max_distance
    limit = F.lit(most)
    for region, d in limits.items():
        limit = F.when(F.col("region_id") == region, d).otherwise(limit)
    most = max([most, *limits.values()])
    targets = library.select("region_id", F.col("seq").alias("hit"), "ids")
    p = probes.where(F.col("seq").isNotNull()).select("region_id", "seq", "anchor").dropDuplicates()
    p = p.select("region_id", "seq", "anchor", F.length("seq").alias("n"), limit.alias("limit"))
    lengths = p.select("region_id", "anchor", "n", "limit").dropDuplicates()
    shown = targets.join(lengths, "region_id").where(_length_fits(lev))
    size = F.least(F.col("n"), F.length("hit"))
    text = F.when(F.col("anchor") == FULL, F.col("hit")).when(F.col("anchor") == HEAD, F.substr("hit", F.lit(1), size)).otherwise(F.right("hit", size))
    shown = shown.select("region_id", "anchor", "n", "limit", "hit", "ids", text.alias("shown")).withColumn("m", F.length("shown"))

    def start(i: Column | int) -> Column:
        return F.floor(F.col("m") * i / (F.col("limit") + 1)).cast("int")

    def seed(i: Column | int, chunk: Column) -> Column:
        return F.struct((F.lit(i) if isinstance(i, int) else i).cast("int").alias("i"), chunk.alias("chunk"))

    short = F.col("m") <= F.col("limit")
    whole = (F.col("anchor") == FULL) & (F.lit(metric == "exact"))  # equal ones only
    chunks = F.transform(F.sequence(F.lit(0), F.col("limit")), lambda i: seed(i, F.substr("shown", start(i) + 1, start(i + 1) - start(i))))
    cut_up = F.when(whole, F.array().cast(CHUNKS)).when(short, F.array(seed(-1, F.lit("")))).otherwise(chunks)
    equal = F.when(F.length("hit") == F.col("n"), F.array(seed(-2, F.col("hit")))).otherwise(F.array().cast(CHUNKS))
    target_seeds = shown.select(
        "region_id", "anchor", "n", "m", "hit", "ids", "shown", packed_bases(F.col("shown")).alias("shown_bits"), F.explode(F.concat(cut_up, equal)).alias("s")
    ).select("region_id", "anchor", "n", "m", "hit", "ids", "shown", "shown_bits", "s.i", "s.chunk")
    if lev:
        sized = p.join(shown.select("region_id", "anchor", "n", "m").dropDuplicates(), ["region_id", "anchor", "n"])
    else:
        sized = p.withColumn("m", F.col("n"))  # what is shown is as long as the probe
    seeds = []
    for i in range(most + 1):
        for d in range(-most, most + 1) if lev else (0,):
            at, long = start(i) + d, start(i + 1) - start(i)
            fits = (F.lit(i) <= F.col("limit")) & (F.lit(abs(d)) <= F.col("limit")) & (at >= 0) & (at + long <= F.col("n"))
            seeds.append(F.when(fits, seed(i, F.substr("seq", at + 1, long))))
    some = F.array_distinct(F.array_compact(F.array(*seeds)))
    near = F.when(whole, F.array().cast(CHUNKS)).when(short, F.array(seed(-1, F.lit("")))).otherwise(some)
    equal = F.when(F.col("m") == F.col("n"), F.array(seed(-2, F.col("seq")))).otherwise(F.array().cast(CHUNKS))
    probe_seeds = sized.select(
        "region_id", "anchor", "n", "m", "seq", "limit", packed_bases(F.col("seq")).alias("bits"), F.explode(F.concat(equal, near)).alias("s")
    )
    probe_seeds = probe_seeds.select("region_id", "anchor", "n", "m", "seq", "limit", "bits", "s.i", "s.chunk")
    # the seeds of a small library go to where the probes are: there are limit + 2 of each sequence and probe length
    small = _estimated_bytes(library) <= BROADCAST
    met = probe_seeds.join(F.broadcast(target_seeds) if small else target_seeds, ["region_id", "anchor", "n", "m", "i", "chunk"])
    if lev:
        value = F.levenshtein("seq", "shown", most)
    else:
        value = F.coalesce(hamming_packed(F.col("bits"), F.col("shown_bits")), hamming(F.col("seq"), F.col("shown")))
    met = met.withColumn("distance", F.when(F.col("i") == -2, 0).otherwise(value).cast("int")).where("distance >= 0 and distance <= limit")
    # a probe has as many near sequences as the library offers, and the shorter a probe the fewer of its kind
    near = met.groupBy("region_id", "seq", "anchor").agg(F.collect_set(F.struct("distance", "hit", "ids")).alias("near"), F.min("distance").alias("distance"))
    same = F.exists("near", lambda x: x["hit"] == F.col("seq"))
    best = F.filter("near", lambda x: F.when(same, x["hit"] == F.col("seq")).otherwise(x["distance"] == F.col("distance")))
    found = F.array_sort(F.transform(best, lambda x: F.struct(x["hit"].alias("hit"), x["ids"].alias("ids"))))
    near = near.select("region_id", "seq", "anchor", "distance", found.alias("found"))
    return near.select("*", F.col("found.hit").alias("hits"), ids_of("found").alias("ids"))


def _estimated_bytes(df: DataFrame) -> int:
    """What Catalyst knows of a table's size without running it: the size of its files, or a very large number."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


CHUNKS = "array<struct<i:int,chunk:string>>"
FOUND = "array<struct<hit:string,ids:array<string>>>"


def ids_of(found: str) -> Column:
    """The sorted members of found sequences."""
    return F.array_sort(F.array_distinct(F.flatten(F.col(found)["ids"])))


def probes_of(regions: DataFrame) -> DataFrame:
    """What to look up for each observed region: itself, or both fragments of one with a gap."""
    anchor = F.when(F.col("kind") == PARTIAL5, TAIL).when(F.col("kind") == PARTIAL3, HEAD).otherwise(FULL)

    def piece(part: int, text: Column, anchor: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), text.alias("piece"), anchor.alias("anchor"))

    two = F.array(piece(1, F.substring_index("seq", "/", 1), F.lit(HEAD)), piece(2, F.substring_index("seq", "/", -1), F.lit(TAIL)))
    parts = F.when(F.col("kind").isin(CENTER, OVERLAP), two).otherwise(F.array(piece(0, F.col("seq"), anchor)))
    return regions.select("*", F.explode(parts).alias("x")).select(*regions.columns, "x.part", "x.piece", "x.anchor")


UNMATCHED, MATCH, MULTI, OVER, NO_LIBRARY = "unmatched", "match", "multimatch", "overmatched", "no_library"


def match_regions(
    regions: DataFrame, library: DataFrame, spec: LibrarySpec, metric: str = "hamming", max_distance: int = 3, max_matches: int = 10
) -> DataFrame:
    """The library match of every observed region: ``match, distance, n_matches, hits, ids, sublib``.

    ``region`` repeats region_id as an aggregate, below which no filter is pushed: whoever asks
    for one region at a time reads one and the same search. Fragments on either side of a gap are looked up apart, each with its own nearest hits, and
    what both hit counts, at the sum of the distances.
    """
    probes = probes_of(regions)
    found = lookup(probes.select("region_id", F.col("piece").alias("seq"), "anchor"), library, metric, max_distance, spec.max_distances())
    found = found.select("region_id", F.col("seq").alias("piece"), "anchor", "distance", "found")
    keys = ["region_id", "seq", "kind", "split"]
    joined = probes.join(found, ["region_id", "piece", "anchor"], "left").groupBy(*keys).agg(
        F.sum("distance").alias("distance"),
        F.max(F.when(F.col("part") <= 1, F.col("found"))).alias("a"),
        F.max(F.when(F.col("part") == 2, F.col("found"))).alias("b"),
        F.max("part").alias("parts"),
        F.max("region_id").alias("region"),
    )
    none = F.array().cast(FOUND)
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    both = F.filter(a, lambda x: F.array_contains(b["hit"], x["hit"]))
    joined = joined.withColumn("found", F.when(F.col("parts") == 0, a).otherwise(both))
    homes = [F.lit(x) for pair in homes_of(library).items() for x in pair]
    home = F.element_at(F.create_map(*homes), F.col("region_id")) if homes else F.lit(None)
    joined = joined.withColumn("sublib", home.cast("int"))
    n = F.size("found")
    kind = (
        F.when(F.col("sublib").isNull(), NO_LIBRARY).when(n == 0, UNMATCHED).when(n == 1, MATCH).when(n > max_matches, OVER).otherwise(MULTI)
    )
    out = joined.withColumn("match", kind)
    shown = F.col("match").isin(MATCH, MULTI)
    return out.select(
        *keys, "region", "match", F.when(n > 0, F.col("distance")).cast("bigint").alias("distance"), n.cast("bigint").alias("n_matches"),
        F.when(shown, F.col("found.hit")).alias("hits"), F.when(shown, ids_of("found")).alias("ids"), "sublib",
    )


def product_of_sizes(ids: Column) -> Column:
    """Number of combinations of sets of ids, where a null set counts as one."""
    sizes = F.transform(ids, lambda s: F.when(s.isNull(), 1).otherwise(F.size(s)).cast("bigint"))
    return F.when(F.size(ids) == 0, F.lit(0)).otherwise(F.aggregate(sizes, F.lit(1).cast("bigint"), lambda a, b: a * b))
