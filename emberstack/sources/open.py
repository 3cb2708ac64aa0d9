"""From a recording's file to a :class:`emberstack.recording.Recording`.

Everything after the parse is DataFrame work: histories of processes and threads, as-of joins of samples with threads, range
joins of addresses with modules and symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberstack.functions import scalars
from emberstack.operators import dictionary, filters, lifetimes, stacks, switches, symbols, temporal
from emberstack.recording import Recording
from emberstack.sources import etl, perf_data
from emberstack.tables import saved

UNKNOWN_MODULE = UNKNOWN = "[unknown]"
SYSTEM = "hostname string, platform string, architecture string, cpu_name string, n_processors int"
SESSION = "command_line string, date timestamp, runtime_ns long"
NANOSECONDS = 10**9
FUNCTIONS = "module string, rel_begin long, rel_end long, symbol string, file string, func_line long"
LINES = "module string, rel_begin long, rel_end long, instr_line long"


@dataclass(frozen=True)
class SymbolOptions:
    """How modules are looked up: rules that map their paths first, wildcards of those that are looked up at all."""

    path_rules: tuple[tuple[str, str, str], ...] = ()
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] | None = None


def open_recording(spark: SparkSession, path: str, store: str, functions: DataFrame | None = None, lines: DataFrame | None = None, options: SymbolOptions = SymbolOptions()) -> Recording:
    """The recording in ``path``, by the extension of its name: ``.data``, ``.etl`` or ``.diagsession``.

    The file is parsed once, into Parquet at ``store`` (replaced if there); all questions read that, and what is joined from it is
    written once too. ``functions`` and ``lines`` are tables of symbols as for :func:`emberstack.operators.symbols.resolved`.
    """
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "data":
        tables = {"events": perf_data.events(spark, path), "attributes": perf_data.attributes(spark, path), "metadata": perf_data.metadata(spark, path)}
    elif kind in ("etl", "diagsession"):
        tables = {"events": etl.events(spark, path), "session": etl.session(spark, path)}
    else:
        raise ValueError(f"unsupported file extension: {path}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{store}/{name}")
    kept = {name: spark.read.parquet(f"{store}/{name}") for name in tables}
    files = kept["attributes" if kind == "data" else "session"].select("path").distinct().count()
    if files > 1:
        raise ValueError(f"{files} recordings at {path}: open each by itself")
    if kind == "data":
        return perf_recording(kept["events"], kept["attributes"], functions, lines, kept["metadata"], options)
    return etl_recording(kept["events"], kept["session"], functions, lines, options)


def _with_epoch(rows: DataFrame, modules: DataFrame, pid: str, ts: str, name: str) -> DataFrame:
    """``rows`` with the time ``name`` of the last module load of their process at or before theirs: between two loads an address
    means the same, so equal stacks are equal at any time."""
    loads = modules.select(F.col("pid").alias(pid), "load_ts", F.col("load_ts").alias("__epoch")).distinct()
    return temporal.asof(rows, loads, pid, ts, "load_ts", "__epoch", [], True, name)


def _named_frames(stacks_of: DataFrame, modules: DataFrame, functions: DataFrame | None, lines: DataFrame | None, options: SymbolOptions) -> DataFrame:
    """The frames of a dictionary ``stacks_of(stack_id, stack, lone)``, whose stacks list ``(pid, ip, epoch)`` outermost first, with module,
    symbol, file and lines, written once; what is looked up is each distinct address of a process and epoch.

    ``modules(pid, module_id, base, size, load_ts, page_offset, filename)``. An address of no module has the module "[unknown]";
    one of no function, or of a module that the options leave out, has a generic name. A lone address has a null depth.
    """
    spark = stacks_of.sparkSession
    frames = stacks_of.select("stack_id", "lone", F.size("stack").alias("n"), F.posexplode("stack").alias("at", "f"))
    depth = F.when(~F.col("lone"), (F.col("at") + 1).cast("long"))
    frames = frames.select("stack_id", depth.alias("depth"), "f.pid", "f.ip", "f.epoch", (F.col("at") + 1 == F.col("n")).alias("is_leaf"))
    held = temporal.module_at(frames.select("pid", "ip", F.col("epoch").alias("t")).distinct(), modules, ["pid"])
    mapped = modules.select(F.col("module_id").alias("m_id"), "base", "page_offset", "filename")
    held = held.join(mapped, F.col("module_id") == F.col("m_id"), "left").select("pid", "ip", F.col("t").alias("epoch"), F.col("filename").alias("file_module"), (F.col("ip") - F.col("base") + F.col("page_offset")).alias("rel"))
    functions = spark.createDataFrame([], FUNCTIONS) if functions is None else functions
    lines = spark.createDataFrame([], LINES) if lines is None else lines
    passes = filters.module_passes(F.col("file_module"), list(options.exclude), None if options.include is None else list(options.include))
    looked_up = F.when(passes, filters.map_path(F.col("file_module"), list(options.path_rules)))
    named = symbols.in_range(symbols.in_range(held.withColumn("module", looked_up), functions, ["symbol", "file", "func_line"]), lines, ["instr_line"])
    named = named.withColumn("symbol", F.coalesce("symbol", scalars.generic_symbol(F.col("file_module"), F.col("ip"))))
    named = named.select(F.col("pid").alias("a_pid"), F.col("ip").alias("a_ip"), F.col("epoch").alias("a_epoch"), F.coalesce("file_module", F.lit(UNKNOWN_MODULE)).alias("module"), "symbol", "file", "func_line", "instr_line")
    frames = frames.join(named, (F.col("pid") == F.col("a_pid")) & (F.col("ip") == F.col("a_ip")) & F.col("epoch").eqNullSafe(F.col("a_epoch")))
    return saved(frames.select("stack_id", "depth", "module", "symbol", "file", "func_line", "instr_line", "is_leaf"))


def _entries(starts: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """``starts(key, ts, seq, *payload)`` to entries ``(key, start_ts, end_ts, *payload)``: what is said at one time is one entry, the last
    value that isn't null counting; each ends where the next begins."""
    at_once = starts.groupBy(key, "ts").agg(F.max("seq").alias("seq"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in payload])
    entries = lifetimes.intervals(at_once.withColumn("kind", F.lit("start")), key, payload)
    return lifetimes.closed_by_next(entries, key)


def processes(events: DataFrame) -> DataFrame:
    """``(process_id, pid, name, start_ts, end_ts)`` from comm and fork records of main threads."""
    main = events.where("kind in ('comm', 'fork') and pid = tid").select("pid", "ts", "seq", F.col("name"))
    found = _entries(main, "pid", ["name"])
    found = temporal.numbered(found, ["pid", "start_ts"], "number")
    return found.select((F.lit(2**32) + F.col("number")).alias("process_id"), "pid", "name", "start_ts", "end_ts").orderBy("process_id")


def threads(events: DataFrame, processes: DataFrame) -> DataFrame:
    """``(thread_id, process_id, tid, name, start_ts, end_ts)``; the process is the one of the pid alive when the thread started."""
    found = _entries(events.where("kind in ('comm', 'fork')").select("tid", "ts", "seq", "pid", "name"), "tid", ["pid", "name"])
    found = temporal.numbered(found, ["tid", "start_ts"], "number").withColumn("thread_id", F.lit(2**33) + F.col("number"))
    owned = temporal.asof(found, processes.select("pid", "start_ts", "process_id"), "pid", "start_ts", "start_ts", "process_id", [], False, "process_id")
    return owned.select("thread_id", "process_id", "tid", "pid", "name", "start_ts", "end_ts")


def sources(events: DataFrame, attributes: DataFrame) -> DataFrame:
    """``(source_id, place, name)``: the attributes that have samples, numbered as they first appear."""
    first = _with_place(perf_data.samples(events), attributes).groupBy("place").agg(F.min("seq").alias("seq"))
    number = (F.row_number().over(Window.orderBy("seq")) - 1).cast("long")  # a recording has few attributes
    named = attributes.select(F.col("place").alias("a_place"), F.coalesce("name", F.concat(F.lit("unknown event "), F.col("config").cast("string"))).alias("name"))
    return first.withColumn("source_id", number).join(named, F.col("place") == F.col("a_place"), "left").select("source_id", "place", "name")


def _with_place(samples: DataFrame, attributes: DataFrame) -> DataFrame:
    """Samples with the place of their attribute; an id of none is of the first."""
    each = attributes.select(F.col("place").alias("a_place"), F.explode("ids").alias("a_id"))
    return samples.join(each, F.col("event_id") == F.col("a_id"), "left").withColumn("place", F.coalesce("a_place", F.lit(0).cast("long"))).drop("a_place", "a_id")


def _in_life(rows: DataFrame, threads: DataFrame) -> DataFrame:
    """``rows(tid, ts, ...)`` with ``thread_id``, ``process_id`` and ``pid`` of the thread of their tid that lived at their time; others go."""
    who = threads.select("tid", "start_ts", F.struct("thread_id", "process_id", "pid", "start_ts", "end_ts").alias("who"))
    rows = temporal.asof(rows, who, "tid", "ts", "start_ts", "who", [], False, "who").where("who is not null")
    rows = rows.where("ts >= who.start_ts and (who.end_ts is null or ts <= who.end_ts)")
    return rows.select(*[c for c in rows.columns if c != "who"], "who.thread_id", "who.process_id", "who.pid")


def perf_recording(events: DataFrame, attributes: DataFrame, functions: DataFrame | None = None, lines: DataFrame | None = None, metadata: DataFrame | None = None, options: SymbolOptions = SymbolOptions()) -> Recording:
    """A recording of one file's ``events`` and ``attributes``; times are nanoseconds. Its processes are the sampled ones.

    A sample without a call chain has one frame, its address, of null depth: it counts for functions, modules, files and lines, not
    for edges and trees. An address of no module has the module "[unknown]" and a generic name.
    """
    spark = events.sparkSession
    all_processes = saved(processes(events))
    all_threads = saved(threads(events, all_processes))
    named_sources = saved(sources(events, attributes))
    rows = _with_place(perf_data.samples(events).drop("pid"), attributes).join(named_sources.select("source_id", F.col("place").alias("s_place")), F.col("place") == F.col("s_place"))
    rows = rows.select(F.col("seq").alias("sample_id"), "source_id", "ts", "tid", "ip", "ips")
    rows = saved(_in_life(rows, all_threads))
    modules = perf_data.modules(events)
    frame = lambda x: F.struct(F.col("pid").alias("pid"), x.alias("ip"), F.col("epoch").alias("epoch"))
    whole = F.when(F.col("ips").isNotNull(), F.transform(F.reverse("ips"), frame)).when(F.col("ip").isNotNull(), F.array(frame(F.col("ip"))))
    held = _with_epoch(rows, modules, "pid", "ts", "epoch").withColumns({"stack": F.when(F.size(whole) > 0, whole), "lone": F.col("ips").isNull()})
    held, distinct = dictionary.interned(held.select("sample_id", "source_id", "ts", "process_id", "thread_id", "stack", "lone"), ["stack", "lone"])
    held, named = saved(held), _named_frames(distinct, modules, functions, lines, options)

    spans = perf_data.samples(events).select("tid", "ts")
    entries = all_threads.join(all_processes.select(F.col("process_id").alias("p_id"), F.col("start_ts").alias("process_start")), F.col("process_id") == F.col("p_id"))
    sampled = lifetimes.sampled_processes(entries.select("tid", "pid", "process_start", "start_ts", "end_ts"), spans)
    sampled = sampled.select(F.col("pid").alias("s_pid"), F.col("process_start").alias("s_start"))
    own = all_processes.join(sampled, (F.col("pid") == F.col("s_pid")) & (F.col("start_ts") == F.col("s_start")), "left_semi")
    said = {r["key"]: r["value"] for r in metadata.collect()} if metadata is not None else {}  # a handful of lines
    times = spans.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    first, last = int(said.get("first_sample_ns") or times["a"] or 0), int(said.get("last_sample_ns") or times["b"] or 0)
    system = spark.createDataFrame([(said.get("hostname", UNKNOWN), " ".join(x for x in ("Linux", said.get("os_release")) if x), said.get("arch", UNKNOWN), said.get("cpu_desc", UNKNOWN), int(said.get("n_cpus", 0)))], SYSTEM)
    session = spark.createDataFrame([(said.get("command_line", UNKNOWN), None, last - first)], SESSION)
    chains = rows.groupBy(F.col("source_id").alias("c_source")).agg(F.max(F.col("ips").isNotNull()).alias("has_stacks"))
    named_sources = named_sources.join(chains, F.col("source_id") == F.col("c_source"), "left").select("source_id", "name", F.coalesce("has_stacks", F.lit(False)).alias("has_stacks"))
    return Recording(held, named, own, all_threads.drop("pid"), ticks_per_second=NANOSECONDS, origin=first, source_names=saved(named_sources), session=session, system=system)


def _device_paths(events: DataFrame) -> tuple[dict[str, str], str]:
    """What stands for device paths on the recorded machine (a handful of volumes), and its system root."""
    devices = {r["nt_path"]: r["dos_path"] for r in etl.records(events, "volume").orderBy("seq").collect() if r["nt_path"]}
    disks = etl.records(events, "physical_disk").groupBy("disk").agg(F.max_by("partitions", "seq").alias("partition")).withColumn("drive", F.lit(None).cast("string"))
    drives = etl.records(events, "logical_disk").select("disk", "partition", "drive")
    for r in symbols.volumes(disks.unionByName(drives)).where("drive is not null").collect():
        devices.setdefault(f"\\Device\\HarddiskVolume{r['volume']}", r["drive"])
    root = etl.records(events, "system_paths").agg(F.min_by("windows_directory", "seq").alias("root")).first()["root"]
    return devices, root or "C:\\WINDOWS"


def etl_recording(events: DataFrame, session: DataFrame, functions: DataFrame | None = None, lines: DataFrame | None = None, options: SymbolOptions = SymbolOptions()) -> Recording:
    """A recording of one file's ``events`` and ``session``; times are nanoseconds since its start.

    Its processes are the targets that the file names with their descendants, else the sampled ones. Kernel frames are of the
    modules of process 0, at the time of their stack. Counter samples of source 0 hide a thread's timer samples.
    """
    spark = events.sparkSession
    head = session.first()  # one file
    ns = lambda c: scalars.ticks_to_ns(F.col(c), F.lit(head["start_ticks"]), head["frequency"])
    record = lambda kind: etl.records(events, kind)

    def lives(kind: str, key: str, payload: list[str]) -> DataFrame:
        changes = F.when(F.col("type").isin(1, 3), "start").when(F.col("type").isin(2, 4), "end")
        rows = record(kind).select("seq", "ts", changes.alias("kind"), key, *payload).where("kind is not null")
        return lifetimes.intervals(rows, key, payload)

    found = saved(lives("process", "pid", ["name", "command_line", "ppid"]))
    found = temporal.numbered(found, ["pid", "start_ts"], "number")
    all_processes = saved(found.withColumn("process_id", F.lit(2**32) + F.col("number")).drop("number"))
    found = temporal.numbered(lives("thread", "tid", ["pid", "name"]), ["tid", "start_ts"], "number")
    found = saved(found.withColumn("thread_id", F.lit(2**33) + F.col("number")).drop("number"))
    all_threads = saved(temporal.asof(found, all_processes.select("pid", "start_ts", "process_id"), "pid", "start_ts", "start_ts", "process_id", [], False, "process_id"))

    place = F.shiftleft(F.col("seq.processor").cast("long"), 44) + F.shiftleft("seq.buffer", 20) + F.col("seq.place")
    timer = record("sample").select(place.alias("sample_id"), F.lit(0).cast("long").alias("source"), "seq", "ts", "tid", "ip")
    counted = record("pmc_sample").select(place.alias("sample_id"), "source", "seq", "ts", "tid", "ip")
    hidden = counted.where("source = 0").select(F.col("tid").alias("h_tid")).distinct()
    rows = counted.unionByName(timer.join(hidden, F.col("tid") == F.col("h_tid"), "left_anti"))
    names = record("sample_interval").where("type = 73").groupBy("source").agg(F.max_by("name", "seq").alias("name"))
    kinds = rows.select(F.col("source").alias("r_source")).distinct().join(names, F.col("r_source") == F.col("source"), "full")
    kinds = kinds.select(F.coalesce("source", "r_source").alias("source"), "name")
    number = (F.row_number().over(Window.orderBy("source")) - 1).cast("long")  # a recording has few sources
    kinds = saved(kinds.select(F.col("source").alias("k_source"), number.alias("source_id"), F.coalesce("name", F.format_string("Unknown (%d)", F.col("source"))).alias("name")))
    rows = saved(_in_life(rows.join(kinds.drop("name"), F.col("source") == F.col("k_source")).drop("source", "k_source"), all_threads))

    own = stacks.direct(rows, record("stack").select("seq", "ts", "event_ts", "tid", "ips"), head["pointer_size"])
    keys = record("stack_key").select("seq", "ts", "event_ts", "tid", "key", (F.col("type") == 37).alias("is_kernel"))
    shared = stacks.keyed(rows, keys, record("stack_body").where("type in (35, 36) and size(ips) > 0").select("seq", "key", "ips"))
    held = saved(stacks.attached(rows, own, shared))
    devices, root = _device_paths(events)
    images = record("image").where("type in (10, 3)")
    infos = record("debug_info").select("seq", "pid", "ts", "base", "debug_file", F.concat("signature", F.lit("-"), F.col("age").cast("string")).alias("signature"))
    modules = stacks.with_debug_info(images.select("seq", "pid", "ts", "base", "size", "filename", "checksum"), infos)
    modules = modules.select("pid", F.struct("seq").alias("module_id"), "base", "size", F.col("ts").alias("load_ts"), F.lit(0).cast("long").alias("page_offset"), symbols.local_path(F.col("filename"), devices, root).alias("filename"), "checksum", "debug_file", "signature")
    modules = saved(modules)
    none, kernel = F.array().cast("array<bigint>"), F.lit(0).cast("long")
    of = F.when(scalars.is_kernel_address(F.col("ip"), head["pointer_size"]), kernel).otherwise(F.col("pid"))
    lone = F.col("user_ips").isNull() & F.col("kernel_ips").isNull()
    # A lone address has a place of its own, as one of the kernel is of process 0.
    timed_ips = held.withColumns({"lone": lone, "k_pid": kernel, "l_pid": F.when(lone, of), "user_ts": F.coalesce("user_ts", "ts"), "kernel_ts": F.coalesce("kernel_ts", "ts")})
    for pid, ts, name in (("pid", "user_ts", "u_epoch"), ("k_pid", "kernel_ts", "k_epoch"), ("l_pid", "ts", "l_epoch")):
        timed_ips = _with_epoch(timed_ips, modules, pid, ts, name)
    frame = lambda ips, pid, epoch: F.transform(F.reverse(F.coalesce(ips, none)), lambda x: F.struct(F.col(pid).alias("pid"), x.alias("ip"), F.col(epoch).alias("epoch")))
    whole = F.concat(frame(F.col("user_ips"), "pid", "u_epoch"), frame(F.col("kernel_ips"), "k_pid", "k_epoch"))
    whole = F.when(lone, frame(F.array("ip"), "l_pid", "l_epoch")).otherwise(whole)
    stacked, distinct = dictionary.interned(timed_ips.select("sample_id", F.when(F.size(whole) > 0, whole).alias("stack"), "lone"), ["stack", "lone"])
    named = _named_frames(distinct, modules, functions, lines, options)

    marked = record("target_started").select("pid", "ts").unionByName(record("profile_target").select("pid", "ts"))
    with_samples = rows.select(F.col("process_id").alias("s_process")).distinct()
    sampled = all_processes.join(with_samples, F.col("process_id") == F.col("s_process"), "left_semi").select("pid", "start_ts")
    targets = lifetimes.targets(all_processes, marked, sampled).select(F.col("pid").alias("t_pid"), F.col("start_ts").alias("t_start"))
    profiled = saved(all_processes.join(targets, (F.col("pid") == F.col("t_pid")) & (F.col("start_ts") == F.col("t_start")), "left_semi"))
    switched = switches.per_thread(record("context_switch").select("seq", "ts", "old_tid", "new_tid", "pmc"), record("thread").select("seq", "ts", "tid"), all_threads.select(F.col("thread_id").alias("thread_key"), "tid", "start_ts"))
    owned = all_threads.join(profiled.select(F.col("process_id").alias("p_id")), F.col("process_id") == F.col("p_id"), "left_semi")
    owned = owned.join(switched, F.col("thread_id") == F.col("thread_key"), "left").drop("thread_key", "pid")
    timed = lambda df: df.withColumns({"start_ts": ns("start_ts"), "end_ts": ns("end_ts")})

    recorder = all_processes.where(scalars.is_recorder(F.col("name"), F.col("command_line"))).agg(F.min_by("command_line", F.struct("start_ts", "pid")).alias("c")).first()["c"]
    date = session.select(scalars.nt_timestamp(F.col("start_time")).alias("d")).first()["d"]
    cpu = record("cpu").agg(F.max_by(F.struct("computer_name", scalars.architecture(F.col("architecture")).alias("architecture")), "seq").alias("c")).first()["c"]
    product = record("build_info").agg(F.min_by("product_name", "seq").alias("p")).first()["p"]
    model = record("pnp").where("description = 'Intel Processor'").agg(F.min_by("friendly_name", "seq").alias("m")).first()["m"]
    about = spark.createDataFrame([(cpu["computer_name"] if cpu else UNKNOWN, product or "Windows", cpu["architecture"] if cpu else UNKNOWN, model or UNKNOWN, head["n_processors"])], SYSTEM)
    ran = spark.createDataFrame([(recorder or UNKNOWN, date, (head["end_time"] - head["start_time"]) * 100)], SESSION)
    met = held.groupBy(F.col("source_id").alias("m_source")).agg(F.max(F.col("user_ips").isNotNull() | F.col("kernel_ips").isNotNull()).alias("has_stacks"))
    kinds = saved(kinds.join(met, F.col("source_id") == F.col("m_source"), "left").select("source_id", "name", F.coalesce("has_stacks", F.lit(False)).alias("has_stacks")))
    samples = rows.join(profiled.select(F.col("process_id").alias("p_id")), F.col("process_id") == F.col("p_id"), "left_semi")
    samples = samples.join(stacked.select(F.col("sample_id").alias("__id"), "stack_id"), F.col("sample_id") == F.col("__id"), "left")
    samples = saved(samples.select("sample_id", "source_id", ns("ts").alias("ts"), "process_id", "thread_id", "stack_id"))
    return Recording(samples, named, timed(profiled), saved(timed(owned)), ticks_per_second=NANOSECONDS, source_names=kinds, session=ran, system=about)


def counts(events: DataFrame, only: list[str] | None = None, without: list[str] | None = None, pid: int | None = None) -> DataFrame:
    """``(kind, n)``: what a file holds, of some kinds or one process if asked so."""
    if only is not None:
        events = events.where(F.col("kind").isin(*only))
    if without:
        events = events.where(~F.coalesce(F.col("kind").isin(*without), F.lit(False)))
    if pid is not None:
        events = events.where(F.col("pid") == pid)
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def counts_by_event(events: DataFrame) -> DataFrame:
    """``(event_id, n, first_ts, last_ts)`` of the samples."""
    return events.where("kind = 'sample'").groupBy("event_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
