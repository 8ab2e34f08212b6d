"""The whole ingest of a batch of documents, published at once.

A batch is hashed, compared with what is archived, enriched (entities, type,
category), completed from the catalogue (aircraft by reference, category by
linked work package), and becomes rows of seven tables. All of them are
written under names of their own and then named by one journal version:
readers see the whole batch or nothing of it, a replayed batch changes
nothing, and what a lost run left behind is never read.

Tables are lists of parts. Checks are kept by change: a reader takes the last
row of each reference, so a release record confirms a check without a rewrite.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docspark import fixed_values as fv
from docspark.functions import labels
from docspark.functions.basics import blank_to_null, extract
from docspark.functions.entities import linked_wp_refs, normalise_es
from docspark.functions.registration import registration_from_path
from docspark.operators.duplicates import with_content_hash
from docspark.operators.joins import linked_categories, resolve_aircraft
from docspark.operators.maintenance import generate_alerts
from docspark.session import stored
from docspark.sources.journal import Conflict, Journal, State
from docspark.streaming.ledger import HashLedger, new_contents
from docspark.streaming.streams import watch_archive

SCHEMAS = {
    "documents": """id long, filename string, rel_path string, sha256_hash string, doc_type string, category string,
        aircraft_registration string, aircraft_id long, es_reference string, check_reference string, ata_chapter string,
        sb_ad_reference string, work_order_number string, part_number string, serial_number string, item_number string,
        ocr_confidence double, classifier_confidence double, method string, registration_method string,
        needs_review boolean, is_critical boolean, status string""",
    "texts": "id long, ocr_text string",
    "aircraft": "id long, registration string, model string, created boolean",
    "checks": "es_reference string, check_type string, aircraft_id long, confirmed boolean, seq long",
    "alerts": "document_id long, aircraft_registration string, title string, message string, severity string, alert_type string",
    "results": "id long, source string, batch long, status string, duplicate_of long",
}


def enriched(batch: DataFrame) -> DataFrame:
    """What a document says by itself, without its text: entities, type,
    category, review flags, linked references. ``batch`` has id, filename,
    rel_path, ocr_text and ocr_confidence; its other columns stay."""
    found = watch_archive(batch.withColumn("linked_refs", linked_wp_refs("ocr_text")))
    named = extract(F.upper("filename"), r"(TS-IN[A-Z])")
    return found.withColumn("aircraft_registration", F.coalesce(
        blank_to_null("e_aircraft_registration"), registration_from_path("rel_path"), named))


def _with_aircraft(docs: DataFrame, archived: DataFrame) -> DataFrame:
    """Registrations the archive knows by reference or file name number."""
    unknown = docs.filter("aircraft_registration IS NULL").select("id", F.col("e_es_reference").alias("es_reference"), "filename")
    solved = resolve_aircraft(unknown, archived).select(
        F.col("id").alias("_id"), F.col("aircraft_registration").alias("_reg"), F.col("method").alias("_how"))
    return docs.join(solved, F.col("id") == F.col("_id"), "left").withColumns({
        "registration_method": F.when(F.col("aircraft_registration").isNotNull(), "document").otherwise(F.col("_how")),
        "aircraft_registration": F.coalesce("aircraft_registration", "_reg")}).drop("_id", "_reg", "_how")


def _with_linked_category(docs: DataFrame, archived: DataFrame) -> DataFrame:
    """Work Orders take the category of the first linked package the archive
    has as a checked Work Order."""
    orders = docs.filter(F.col("predicted_type") == "Work Order").select("id", F.posexplode("linked_refs").alias("pos", "ref"))
    refs = stored(orders.select("id", "pos", normalise_es("ref").alias("number")).filter("number <> ''"), "linked")
    hits = linked_categories(refs.select("number").distinct(), archived)
    first = refs.join(hits, "number").groupBy(F.col("id").alias("_id")).agg(
        F.min_by("linked_category", "pos").alias("_category"))
    return docs.join(first, F.col("id") == F.col("_id"), "left").withColumn(
        "predicted_category", F.coalesce("_category", "predicted_category")).drop("_id", "_category")


class Archive:
    """Seven tables in `folder`, each a list of parts in the journal."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.journal = Journal(spark, f"{folder}/journal")
        self.ledger = HashLedger(spark, f"{folder}/ledger")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self._table(name, self.journal.read(version)[1])

    def _table(self, name: str, state: State) -> DataFrame:
        paths = [f"{self.folder}/{name}/{part}" for part in state.get(name, [])]
        schema = SCHEMAS[name]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if name != "checks":
            return rows
        last = F.max(F.struct("seq", "check_type", "aircraft_id", "confirmed")).alias("_r")
        return rows.groupBy("es_reference").agg(last).select(
            "es_reference", "_r.check_type", "_r.aircraft_id", "_r.confirmed", "_r.seq")

    def _write(self, name: str, rows: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.parquet(
            f"{self.folder}/{name}/{part}")
        return part

    def seed(self, **tables: DataFrame) -> int:
        """The first version, from tables as they are; ``hashes`` (sha256_hash,
        id, at) are contents known already."""
        state: State = {"batches": {}, "ledger": []}
        if "hashes" in tables:
            state["ledger"] = [self.ledger.write(tables.pop("hashes"))]
        for name, rows in tables.items():
            state[name] = [self._write(name, rows)]
        return self.journal.publish(state, -1)

    def ingest(self, batch: DataFrame, source: str, number: int, content: str = "ocr_text", at: int = 0) -> int:
        """Archive batch `number` of `source`; the version that holds it.

        Batches of a source are numbered upwards. One that is in already, or
        is published meanwhile by another run, changes nothing. Ids are
        unique. Of equal contents the least id is archived, unless the
        archive has the content; rows with a null content are all archived.
        """
        while True:
            version, state = self.journal.read()
            if state.get("batches", {}).get(source, -1) >= number:
                return version
            try:
                return self.journal.publish(self._change(state, version, batch, source, number, content, at), version)
            except Conflict:
                # Another batch came first; this one must see what it added.
                continue

    def _change(self, state: State, version: int, batch: DataFrame, source: str, number: int, content: str, at: int) -> State:
        archived, fleet, checks = (self._table(n, state) for n in ("documents", "aircraft", "checks"))
        found = stored(enriched(with_content_hash(batch, content).drop(*({content} - {"ocr_text"}))), "enriched")
        decided = stored(new_contents(found, self.ledger, state.get("ledger", [])), "decided")
        fresh = found.join(decided.filter("duplicate_of IS NULL").select("id"), "id", "left_semi")
        whole = stored(_with_linked_category(_with_aircraft(fresh, archived), archived), "completed")

        planes = whole.select(F.upper("aircraft_registration").alias("registration")).filter(
            "registration <> ''").distinct()
        new_planes = stored(planes.join(fleet.select(F.upper("registration").alias("registration")), "registration", "left_anti").select(
            # A key from the registration: the same in every run.
            F.pmod(F.xxhash64("registration"), F.lit(1 << 62)).alias("id"), "registration",
            F.lit(fv.DEFAULT_AIRCRAFT_MODEL).alias("model"), F.lit(True).alias("created")), "aircraft")
        keys = fleet.select(F.col("id").alias("aircraft_id"), F.upper("registration").alias("_reg")).union(
            new_planes.select("id", "registration"))
        is_record = F.col("predicted_type") == "RCT"
        documents = stored(whole.join(keys, F.upper("aircraft_registration") == F.col("_reg"), "left").select(
            "id", "filename", "rel_path", "sha256_hash", F.col("predicted_type").alias("doc_type"),
            F.col("predicted_category").alias("category"), "aircraft_registration", "aircraft_id",
            F.col("e_es_reference").alias("es_reference"),
            F.upper(F.when(is_record, F.coalesce("e_linked_wp", "e_es_reference")).otherwise(F.col("e_es_reference"))).alias("check_reference"),
            F.col("e_ata_chapter").alias("ata_chapter"), F.col("e_sb_ad_reference").alias("sb_ad_reference"),
            F.col("e_work_order_number").alias("work_order_number"), F.col("e_part_number").alias("part_number"),
            F.col("e_serial_number").alias("serial_number"), F.col("e_item_number").alias("item_number"), "ocr_confidence",
            F.col("confidence").alias("classifier_confidence"), "method", "registration_method", "needs_review", "is_critical",
            F.lit("PENDING").alias("status"), F.col("e_check_type").alias("_record_type")), "documents")
        changed = self._check_changes(documents, checks, version + 1)
        alerts = generate_alerts(documents.withColumn("file_present", F.lit(True)))
        results = decided.select(
            "id", F.lit(source).alias("source"), F.lit(number).alias("batch"),
            F.when(F.col("duplicate_of").isNull(), "ARCHIVED").otherwise("DUPLICATE").alias("status"), "duplicate_of")
        texts = batch.select("id", "ocr_text").join(documents.select("id"), "id", "left_semi")
        hashes = documents.filter("sha256_hash IS NOT NULL").select("sha256_hash", "id", F.lit(at).alias("at"))

        new = json.loads(json.dumps(state))
        for name, rows in (("documents", documents), ("texts", texts), ("aircraft", new_planes), ("checks", changed),
                           ("alerts", alerts), ("results", results)):
            new.setdefault(name, []).append(self._write(name, rows))
        new["ledger"] = self.ledger.kept([*state.get("ledger", []), self.ledger.write(hashes)])
        new.setdefault("batches", {})[source] = number
        return new

    @staticmethod
    def _check_changes(documents: DataFrame, checks: DataFrame, seq: int) -> DataFrame:
        """Checks inferred from documents of unknown references (the lowest id
        decides), and checks that release records confirm (the highest)."""
        rows = documents.filter("check_reference <> '' AND aircraft_id IS NOT NULL")
        known = checks.select(F.col("es_reference").alias("check_reference"))
        inferred = rows.join(known, "check_reference", "left_anti").groupBy("check_reference").agg(
            F.min_by(F.struct("category", "aircraft_id"), "id").alias("_r")).select(
            F.col("check_reference").alias("es_reference"), labels.inferred_check_type("_r.category").alias("check_type"),
            "_r.aircraft_id", F.lit(False).alias("confirmed"))
        names = F.create_map(*[F.lit(x) for kv in fv.CHECK_TYPE_NAMES.items() for x in kv])
        records = rows.filter((F.col("doc_type") == "RCT") & F.col("_record_type").isNotNull()).withColumn(
            "_type", F.element_at(names, F.col("_record_type"))).filter("_type IS NOT NULL").groupBy("check_reference").agg(
            F.max_by(F.struct("_type", "aircraft_id"), "id").alias("_r")).select(
            F.col("check_reference").alias("es_reference"), F.col("_r._type").alias("check_type"), "_r.aircraft_id",
            F.lit(True).alias("confirmed"))
        both = inferred.join(records.select("es_reference"), "es_reference", "left_anti").unionByName(records)
        return both.withColumn("seq", F.lit(seq))

    def writer(self, source: str, content: str = "ocr_text") -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch`` of a stream of batches."""
        def write(batch: DataFrame, number: int) -> None:
            # A stream's plan can't be read twice; the batch is written once.
            self.ingest(stored(batch, "batch"), source, number, content)

        return write

    def compact(self, name: str) -> bool:
        """One part instead of many, published like a batch; False if another
        writer was first."""
        version, state = self.journal.read()
        if len(state.get(name, [])) < 2:
            return False
        part = self._write(name, self._table(name, state))
        try:
            self.journal.publish(state | {name: [part]}, version)
        except Conflict:
            return False
        return True
