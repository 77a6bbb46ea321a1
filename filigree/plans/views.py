"""Stored tables derived from the driver's TPC-H-like tables, once in Spark and once in SQL.

Orders become filings with restated figures, order priorities and suppliers become listed
securities, events become ticks and requests. The number of issuers, listings, facts and
bars grows with the input. Money is summed in whole cents, so sums are exact in any order.
"""

from __future__ import annotations

from copy import copy

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..reference_data import constant_frame
from ..sources.staging import shuffle_partitions, stage
from ..sources.tables import Tables

AS_OF = "2001-08-02"
#: The quarter that the orders have reached: its year has year-to-date figures up to it and no annual ones yet.
LAST_YEAR, LAST_QUARTER = 2001, 3
#: An order becomes some fifty facts; a task should sort the facts of its issuers in memory.
ORDERS_A_TASK = 125_000
MEASURES = ("rev", "gross", "opinc", "ni", "cfo", "capex", "ltd", "cpltd", "cash")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


# The derived facts: concept, value, unit, taxonomy, kind, accession suffix.
_FACTS = (
    ("Revenues", "revenue"),
    ("RevenueFromContractWithCustomerExcludingAssessedTax", "CASE WHEN seg = 1 THEN revenue WHEN seg = 2 AND annual THEN revenue * 1.05D END"),
    ("GrossProfit", "gross / 100.0D"),
    ("OperatingIncomeLoss", "opinc / 100.0D"),
    ("NetIncomeLoss", "ni / 100.0D"),
    ("Revenues", "IF(annual AND own AND seg = 0, revenue * 1.02D, NULL)", "USD", "us-gaap", "duration", "-A"),
    ("WeightedAverageNumberOfDilutedSharesOutstanding", "IF(seg = 2 AND NOT annual, NULL, shares)", "shares"),
    ("EarningsPerShareDiluted", "ni / 100.0D / shares", "USD/shares"),
    ("NetCashProvidedByUsedInOperatingActivities", "cfo / 100.0D"),
    ("PaymentsToAcquirePropertyPlantAndEquipment", "capex / 100.0D"),
    ("CashAndCashEquivalentsAtCarryingValue", "cash / 100.0D", "USD", "us-gaap", "instant"),
    ("Cash", "IF(seg = 2, cash / 100.0D * 1.2D, NULL)", "USD", "us-gaap", "instant"),
    ("ShortTermInvestments", "IF(seg IN (1, 2, 3), gross / 100.0D, NULL)", "USD", "us-gaap", "instant"),
    ("ShortTermBorrowings", "IF(seg IN (1, 3), opinc / 100.0D, NULL)", "USD", "us-gaap", "instant"),
    ("CommercialPaper", "CASE seg WHEN 1 THEN opinc / 100.0D WHEN 4 THEN capex / 100.0D END", "USD", "us-gaap", "instant"),
    ("LongTermDebtCurrent", "cpltd / 100.0D", "USD", "us-gaap", "instant"),
    ("LongTermDebtNoncurrent", "ltd / 100.0D", "USD", "us-gaap", "instant"),
    ("StockholdersEquity", "(rev - coalesce(ltd, 0) * 3) / 100.0D", "USD", "us-gaap", "instant"),
    ("EntityCommonStockSharesOutstanding", "IF(annual AND own, 1000.0D, NULL)", "shares", "dei", "cover"),
    ("EntityCommonStockSharesOutstanding", "IF(annual AND own AND seg = 0, 2000.0D, NULL)", "shares", "dei", "cover", "-A"),
)


def _fact_value(concept, value, unit="USD", taxonomy="us-gaap", kind="duration", suffix="") -> str:
    return f"CAST({f'IF(k IN (2, 4), {value}, NULL)' if kind == 'instant' else value} AS double)"


def _fact_kind(concept, value, unit="USD", taxonomy="us-gaap", kind="duration", suffix="") -> tuple[str, ...]:
    return taxonomy, concept, unit, kind, suffix


class Inputs:
    """The given tables of one scale factor and the stored tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._parts: int | None = None
        self._periods: DataFrame | None = None
        self._quotes: DataFrame | None = None

    def shared(self) -> Inputs:
        """The same inputs with issuers' periods and quotes written once, for plans that read them in several branches.

        Both are small beside the facts and bars that they come from or unfold into.
        """
        out = copy(self)
        out._periods = stage(self._issuer_periods(), "cik", self.issuer_parts())
        out._quotes = stage(self.quotes())
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- facts ---------------------------------------------------------------------------------------------------

    def _period_sums(self, whole_years: bool = False) -> DataFrame:
        """Cumulative sums in cents per customer, year and quarter-to-date; ``whole_years``: the last year has all quarters too."""
        last = "4" if whole_years else f"IF(y = {LAST_YEAR}, {LAST_QUARTER}, 4)"
        rows = self.table("orders").selectExpr(
            "o_custkey AS custkey", "year(o_orderdate) AS y", "quarter(o_orderdate) AS q", "o_orderstatus AS status",
            "CAST(round(o_totalprice * 100) AS bigint) AS rev", "substring(o_orderpriority, 1, 1) AS prio",
        ).selectExpr(
            "custkey", "y", f"explode(sequence(q, {last})) AS k", "rev", "IF(prio IN ('1', '2'), rev, 0) AS gross",
            "IF(prio = '1', rev, 0) AS opinc", "CASE status WHEN 'F' THEN rev WHEN 'O' THEN -rev ELSE 0 END AS ni",
            "IF(status IN ('F', 'P'), rev, 0) AS cfo", "IF(prio = '5', rev, NULL) AS capex",
            "IF(prio = '3', rev, NULL) AS ltd", "IF(prio = '4', rev, NULL) AS cpltd", "IF(status = 'P', rev, NULL) AS cash",
        )
        return rows.groupBy("custkey", "y", "k").agg(*[F.sum(m).alias(m) for m in MEASURES])

    def period_values(self, whole_years: bool = False) -> DataFrame:
        sums = self._period_sums(whole_years)
        c = self.table("customer")
        segments = ", ".join(f"'{s}'" for s in SEGMENTS)
        by_customer = sums.join(
            c.selectExpr("c_custkey AS custkey", f"CAST(array_position(array({segments}), c_mktsegment) - 1 AS int) AS seg"),
            "custkey",
        )
        by_customer = by_customer.selectExpr(
            "lpad(CAST(custkey + 1000000 AS string), 10, '0') AS cik", "seg", "y", "k", *MEASURES
        )
        by_nation = (
            sums.join(c.selectExpr("c_custkey AS custkey", "c_nationkey"), "custkey")
            .groupBy("c_nationkey", "y", "k")
            .agg(*[F.sum(m).alias(m) for m in MEASURES])
            .join(self.table("nation").selectExpr("n_nationkey AS c_nationkey", "n_regionkey AS seg"), "c_nationkey")
            .selectExpr("lpad(CAST(c_nationkey + 1 AS string), 10, '0') AS cik", "seg", "y", "k", *MEASURES)
        )
        return by_customer.unionByName(by_nation)

    def _issuer_periods(self, whole_years: bool = False) -> DataFrame:
        """Period values dealt by issuer."""
        if self._periods is not None and not whole_years:
            return self._periods
        return self.period_values(whole_years).repartition(self.issuer_parts(), "cik")

    def facts(self, whole_years: bool = False, beside: DataFrame | None = None) -> DataFrame:
        """Own and comparative figures of every filing: a year's values also appear in the issuer's next filing, if it has one.

        ``beside`` has further columns by issuer (``cik``); they are joined before the values are unfolded.
        """
        following = F.lead("y").over(Window.partitionBy("cik", "k").orderBy("y"))
        filed = F.when(following == F.col("y") + 1, F.array(F.col("y"), F.col("y") + 1)).otherwise(F.array("y"))
        # dealt by issuer before the values are unfolded: what groups or joins facts by issuer does not shuffle them again
        pv = self._issuer_periods(whole_years).withColumn("filed", filed).withColumn("fy", F.explode("filed")).drop("filed")
        more = [] if beside is None else [c for c in beside.columns if c != "cik"]
        if beside is not None:
            pv = pv.join(beside, "cik")
        pv = pv.selectExpr(
            "*",
            "k = 4 AS annual",
            "fy = y AS own",
            "IF(seg = 4 AND fy >= 2001, 10000.0D, 1000.0D) AS shares",
            "CASE WHEN k >= 3 AND fy <> y AND seg = 3 THEN CAST(round(rev * 0.97D) AS bigint) / 100.0D ELSE rev / 100.0D END AS revenue",
            "last_day(make_date(y, k * 3, 1)) AS period_end",
            "IF(k = 4, make_date(fy + 1, 2, 15), date_add(last_day(make_date(fy, k * 3, 1)), 40)) AS filed_date",
            "concat(cik, '-', lpad(CAST(fy % 100 AS string), 2, '0'), '-00000', CAST(k AS string)) AS accession",
        )
        # Only the values are unfolded; what depends on a value's place alone is joined afterwards, so a filter by tag reaches those twenty rows. The
        # code that Spark makes of this stays below 8,000 bytes, beyond which the JVM does not compile a method.
        values = ", ".join(_fact_value(*f) for f in _FACTS)
        kinds = constant_frame(self.spark, [(place, *_fact_kind(*f)) for place, f in enumerate(_FACTS)], "place, taxonomy, concept, unit, kind, suffix")
        out = pv.selectExpr("cik", "y", "fy", "k", "annual", "accession", "filed_date", "period_end", *more, f"posexplode(array({values})) AS (place, value)").where("value IS NOT NULL")
        return out.join(F.broadcast(kinds), "place").selectExpr(
            "cik", "taxonomy", "concept", "unit", "value", "IF(kind = 'duration', make_date(y, 1, 1), NULL) AS period_start",
            "IF(kind = 'cover', make_date(fy + 1, 1, 31), period_end) AS period_end", "CAST(fy AS int) AS fiscal_year",
            "IF(k = 4, 'FY', concat('Q', CAST(k AS string))) AS fiscal_period", "IF(annual, '10-K', '10-Q') AS form",
            "filed_date", "concat(accession, suffix) AS accession_no", *more,
        )

    def stored_facts(self) -> DataFrame:
        """The facts as a written table in buckets of issuers, for plans that read them in several branches."""
        return stage(self.facts(), "cik", self.issuer_parts())

    def issuer_parts(self) -> int:
        """Into how many parts the issuers are dealt: a multiple of the shuffle partitions that grows with the orders."""
        if self._parts is None:
            least = shuffle_partitions(self.spark)
            self._parts = least * max(1, -(-self.table("orders").count() // (ORDERS_A_TASK * least)))
        return self._parts

    # --- bars ----------------------------------------------------------------------------------------------------

    def raw_bars(self) -> DataFrame:
        """One row per line item as a price row of its supplier's listing; dates repeat."""
        li = self.table("lineitem")
        price = F.col("l_extendedprice")
        return li.select(
            (F.col("l_suppkey") + 1000).alias("security_id"),
            F.col("l_shipdate").cast("date").alias("trade_date"),
            price.alias("open"),
            (price * (1 + F.col("l_tax"))).alias("high"),
            (price * (1 - F.col("l_discount"))).alias("low"),
            F.when(F.col("l_linestatus") == "O", price).otherwise(price * 0.95).alias("close"),
            F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("bigint").alias("volume"),
            F.col("l_orderkey").alias("arrival"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("partkey"),
            F.col("l_extendedprice").alias("raw_price"),
        )

    def bars(self) -> DataFrame:
        o = self.table("orders")
        dense = o.groupBy(
            F.substring("o_orderpriority", 1, 1).cast("bigint").alias("security_id"),
            F.col("o_orderdate").cast("date").alias("trade_date"),
        ).agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count("*").alias("volume"),
            F.max("o_orderkey").alias("source_id"),
        )
        li = self.table("lineitem")
        order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
        listed = li.groupBy(
            (F.col("l_suppkey") + 1000).alias("security_id"), F.col("l_shipdate").cast("date").alias("trade_date")
        ).agg(
            F.min_by("l_extendedprice", order).alias("open"),
            F.max("l_extendedprice").alias("high"),
            F.min("l_extendedprice").alias("low"),
            F.max_by("l_extendedprice", order).alias("close"),
            F.count("*").alias("volume"),
            F.max("l_orderkey").alias("source_id"),
        )
        return dense.unionByName(listed)

    def listed(self) -> DataFrame:
        """The listings of ``bars``, without making them."""
        dense = self.table("orders").select(F.substring("o_orderpriority", 1, 1).cast("bigint").alias("security_id"))
        return dense.unionByName(self.table("lineitem").select((F.col("l_suppkey") + 1000).alias("security_id"))).distinct()

    # --- listings, quotes, retrievals ------------------------------------------------------------------------------

    def securities(self) -> DataFrame:
        o = self.table("orders").select("o_orderpriority").distinct()
        sid = F.substring("o_orderpriority", 1, 1).cast("bigint")
        none = F.lit(None).cast("string")
        dense = o.select(
            sid.alias("security_id"),
            F.when(sid.isin(1, 2), "0000000001").when(sid == 3, "0000000002").when(sid == 4, "0000000003").alias("cik"),
            F.upper(F.substring("o_orderpriority", 3, 3)).alias("ticker"),
            F.col("o_orderpriority").alias("name"),
            F.lit("NYSE").alias("exchange"),
            F.lit("Technology").alias("sector"),
            F.lit("Semiconductors").alias("industry"),
            F.lit("nasdaq").alias("sector_source"),
            F.lit("3674").alias("sic"),
            F.lit("sec").alias("sic_source"),
        )
        s = self.table("supplier")
        n = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        sup = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        half = F.floor(F.col("s_suppkey") / 2)
        listed = sup.select(
            (F.col("s_suppkey") + 1000).alias("security_id"),
            F.when(F.col("s_acctbal") >= 0, F.lpad((half + 1000000).cast("string"), 10, "0")).alias("cik"),
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
            F.col("s_name").alias("name"),
            F.when(F.col("s_acctbal") > 5000, "NYSE").otherwise("Nasdaq").alias("exchange"),
            F.when(F.col("r_name") == "MIDDLE EAST", "N/A").otherwise(F.col("r_name")).alias("sector"),
            F.when(F.col("r_name") != "MIDDLE EAST", F.col("n_name")).alias("industry"),
            F.lit("nasdaq").alias("sector_source"),
            F.when(F.col("r_name") != "AFRICA", (F.col("n_nationkey") + 3570).cast("string")).alias("sic"),
            F.when(F.col("r_name") != "AFRICA", "sec").otherwise(none).alias("sic_source"),
        )
        return dense.unionByName(listed)

    def quotes(self, bars: DataFrame | None = None) -> DataFrame:
        """Two quotes per listing: at its first bar and at its last bar before the as-of date."""
        if bars is None and self._quotes is not None:
            return self._quotes
        bars = (self.bars() if bars is None else bars).where(F.col("trade_date") <= F.lit(AS_OF).cast("date"))
        recent = F.col("trade_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 365)
        agg = bars.groupBy("security_id").agg(
            F.min("trade_date").alias("d0"), F.min_by("close", "trade_date").alias("c0"),
            F.max("trade_date").alias("d1"), F.max_by("close", "trade_date").alias("c1"),
            F.max_by("source_id", "trade_date").alias("source_id"),
            F.max(F.when(recent, F.col("high"))).alias("top"),
        )
        year_high = F.when(F.col("security_id") == 3, F.col("top") * 1.01).otherwise(F.col("top"))

        def quote(day: str, close: str, high: Column) -> Column:
            cap = F.when(F.col(close) < 90000, F.col(close) * 1000)
            return F.struct(
                F.col(day).alias("quote_date"), F.col(close).alias("last_price"), cap.alias("market_cap"),
                high.cast("double").alias("year_high"), F.lit(None).cast("double").alias("year_low"),
            )

        pair = F.array(quote("d0", "c0", F.lit(None)), quote("d1", "c1", year_high))
        # a listing with a single bar has a single quote
        return agg.select("security_id", "source_id", "d0", "d1", F.inline(pair)).where(
            (F.col("d0") != F.col("d1")) | F.col("year_high").isNotNull()
        ).drop("d0", "d1")

    def sources(self) -> DataFrame:
        o = self.table("orders")
        status, prio = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
        cik = F.lpad((F.col("o_custkey") + 1000000).cast("string"), 10, "0")
        return o.select(
            F.col("o_orderkey").alias("source_id"),
            F.when(status == "F", "sec").when(status == "O", "nasdaq").otherwise("cboe").alias("provider"),
            F.when(status == "F", "companyfacts").when(status == "O", "equity.quote").otherwise("equity.historical").alias("dataset"),
            F.lit(None).cast("string").alias("url"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("retrieved_at"),
            F.concat(F.lit("sha256:"), F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("content_hash"),
            F.when((status == "F") & (prio == "4"), '{"notes": ["UNSUPPORTED_TAXONOMY:ifrs-full"]}').alias("detail"),
            F.lit("GET").alias("command"),
            F.concat(F.lit('{"cik": "'), cik, F.lit('"}')).alias("parameters"),
            F.when(status != "P", "v1").alias("provider_version"),
            F.when(status != "O", F.col("o_orderdate").cast("timestamp_ntz")).alias("as_of"),
            (prio == "5").alias("is_fallback"),
        )

    def filings(self) -> DataFrame:
        """One filing per order of the customer's issuer."""
        o = self.table("orders")
        prio, status = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
        form = (
            F.when(prio == "1", "8-K").when(prio == "2", "10-Q").when(prio == "3", "4").when(prio == "4", "SC 13G").otherwise("S-1")
        )
        items = F.when(prio == "1", F.when(status == "F", "2.02,9.01").when(status == "O", "1.01,5.02,1.02, 9.01").otherwise("9.01"))
        return o.select(
            F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("-01-000001")).alias("accession_no"),
            F.lpad((F.col("o_custkey") + 1000000).cast("string"), 10, "0").alias("cik"),
            form.alias("form"),
            F.col("o_orderdate").cast("date").alias("filing_date"),
            F.when(status != "P", F.date_sub(F.col("o_orderdate").cast("date"), 30)).alias("report_date"),
            F.when(status == "F", "doc.htm").alias("primary_document"),
            items.alias("items"),
        )

    def issuers(self) -> DataFrame:
        """Every customer's issuer: cik and ticker."""
        return self.table("customer").select(
            F.lpad((F.col("c_custkey") + 1000000).cast("string"), 10, "0").alias("cik"),
            F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"),
            F.col("c_name").alias("name"),
        )

    def tables(self) -> Tables:
        """The stored tables; facts and bars are read by several branches, so they are written first, as a load would."""
        bars = stage(self.bars())
        return Tables(
            securities=self.securities(), facts=self.stored_facts(), bars=bars, quotes=self.quotes(bars), sources=self.sources(),
            fact_buckets=self.issuer_parts(),
        )


# --- the same views in SQL ---------------------------------------------------------------------------------------

_SUMS = ", ".join(f"sum({m})::BIGINT AS {m}" for m in MEASURES)
_PV_COLUMNS = ", ".join(MEASURES)


def _fact_sql(concept, value, unit="USD", taxonomy="us-gaap", start="make_date(y,1,1)", end=None, suffix=""):
    end = end or "last_day(make_date(y, 3*k, 1))"
    return (
        f"{{'taxonomy': '{taxonomy}', 'concept': '{concept}', 'unit': '{unit}', 'value': CAST({value} AS DOUBLE), "
        f"'period_start': CAST({start} AS DATE), 'period_end': CAST({end} AS DATE), 'suffix': '{suffix}'}}"
    )


def _instant_sql(concept, value):
    return _fact_sql(concept, f"CASE WHEN k IN (2,4) THEN {value} END", start="NULL")


_REV = "(CASE WHEN k >= 3 AND fy <> y AND seg = 3 THEN CAST(round(rev * 0.97::DOUBLE) AS BIGINT)/100.0::DOUBLE ELSE rev/100.0::DOUBLE END)"
_SH = "(CASE WHEN seg = 4 AND fy >= 2001 THEN 10000.0::DOUBLE ELSE 1000.0::DOUBLE END)"


def _c(m):
    return f"({m}/100.0::DOUBLE)"


def _cover_sql(condition, value, suffix=""):
    return _fact_sql(
        "EntityCommonStockSharesOutstanding", f"CASE WHEN k = 4 AND fy = y {condition} THEN {value} END", "shares",
        "dei", "NULL", "make_date(fy+1, 1, 31)", suffix,
    )


_FACT_ROWS = ",\n".join(
    [
        _fact_sql("Revenues", _REV),
        _fact_sql(
            "RevenueFromContractWithCustomerExcludingAssessedTax",
            f"CASE WHEN seg = 1 THEN {_REV} WHEN seg = 2 AND k = 4 THEN {_REV} * 1.05::DOUBLE END",
        ),
        _fact_sql("GrossProfit", _c("gross")),
        _fact_sql("OperatingIncomeLoss", _c("opinc")),
        _fact_sql("NetIncomeLoss", _c("ni")),
        _fact_sql("Revenues", f"CASE WHEN k = 4 AND fy = y AND seg = 0 THEN {_REV} * 1.02::DOUBLE END", suffix="-A"),
        _fact_sql("WeightedAverageNumberOfDilutedSharesOutstanding", f"CASE WHEN seg <> 2 OR k = 4 THEN {_SH} END", "shares"),
        _fact_sql("EarningsPerShareDiluted", f"{_c('ni')} / {_SH}", "USD/shares"),
        _fact_sql("NetCashProvidedByUsedInOperatingActivities", _c("cfo")),
        _fact_sql("PaymentsToAcquirePropertyPlantAndEquipment", _c("capex")),
        _instant_sql("CashAndCashEquivalentsAtCarryingValue", _c("cash")),
        _instant_sql("Cash", f"CASE WHEN seg = 2 THEN {_c('cash')} * 1.2::DOUBLE END"),
        _instant_sql("ShortTermInvestments", f"CASE WHEN seg IN (1,2,3) THEN {_c('gross')} END"),
        _instant_sql("ShortTermBorrowings", f"CASE WHEN seg IN (1,3) THEN {_c('opinc')} END"),
        _instant_sql("CommercialPaper", f"CASE WHEN seg = 1 THEN {_c('opinc')} WHEN seg = 4 THEN {_c('capex')} END"),
        _instant_sql("LongTermDebtCurrent", _c("cpltd")),
        _instant_sql("LongTermDebtNoncurrent", _c("ltd")),
        _instant_sql("StockholdersEquity", "((rev - coalesce(ltd, 0) * 3)/100.0::DOUBLE)"),
        _cover_sql("", "1000.0"),
        _cover_sql("AND seg = 0", "2000.0", "-A"),
    ]
)

SQL_FACTS = f"""
v_order AS (
  SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, substr(o_orderpriority, 1, 1) AS prio FROM orders),
v_sums AS (
  SELECT custkey, y, k, {_SUMS} FROM (
    SELECT o_custkey AS custkey, year(o_orderdate) AS y, unnest(generate_series(quarter(o_orderdate), CASE WHEN year(o_orderdate) = {LAST_YEAR} THEN {LAST_QUARTER} ELSE 4 END)) AS k,
      cents AS rev, CASE WHEN prio IN ('1','2') THEN cents ELSE 0 END AS gross,
      CASE WHEN prio = '1' THEN cents ELSE 0 END AS opinc,
      CASE o_orderstatus WHEN 'F' THEN cents WHEN 'O' THEN -cents ELSE 0 END AS ni,
      CASE WHEN o_orderstatus IN ('F','P') THEN cents ELSE 0 END AS cfo,
      CASE WHEN prio = '5' THEN cents END AS capex, CASE WHEN prio = '3' THEN cents END AS ltd,
      CASE WHEN prio = '4' THEN cents END AS cpltd, CASE WHEN o_orderstatus = 'P' THEN cents END AS cash
    FROM v_order) GROUP BY custkey, y, k),
v_pv AS (
  SELECT lpad(CAST(custkey + 1000000 AS VARCHAR), 10, '0') AS cik,
    list_position({list(SEGMENTS)!r}, c_mktsegment) - 1 AS seg, y, k, {_PV_COLUMNS}
  FROM v_sums JOIN customer ON c_custkey = custkey
  UNION ALL
  SELECT lpad(CAST(n_nationkey + 1 AS VARCHAR), 10, '0'), n_regionkey, y, k, {_PV_COLUMNS} FROM (
    SELECT c_nationkey, y, k, {_SUMS} FROM v_sums JOIN customer ON c_custkey = custkey GROUP BY c_nationkey, y, k)
  JOIN nation ON n_nationkey = c_nationkey),
v_filed AS (
  SELECT *, cik || '-' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') || '-00000' || k AS accession,
    CASE WHEN k = 4 THEN make_date(fy + 1, 2, 15) ELSE CAST(last_day(make_date(fy, 3*k, 1)) + 40 AS DATE) END AS filed_date,
    CASE WHEN k = 4 THEN '10-K' ELSE '10-Q' END AS form
  FROM (SELECT *, unnest(CASE WHEN after = y + 1 THEN [y, y + 1] ELSE [y] END) AS fy
    FROM (SELECT *, lead(y) OVER (PARTITION BY cik, k ORDER BY y) AS after FROM v_pv))),
v_facts AS (
  SELECT cik, f.taxonomy AS taxonomy, f.concept AS concept, f.unit AS unit, f.value AS value,
    f.period_start AS period_start, f.period_end AS period_end, CAST(fy AS INTEGER) AS fiscal_year,
    CASE WHEN k = 4 THEN 'FY' ELSE 'Q' || k END AS fiscal_period, form, filed_date, accession || f.suffix AS accession_no
  FROM (SELECT cik, fy, k, accession, filed_date, form, unnest([{_FACT_ROWS}]) AS f FROM v_filed)
  WHERE f.value IS NOT NULL)"""

_LAST_SQL = f"CASE WHEN year(o_orderdate) = {LAST_YEAR} THEN {LAST_QUARTER} ELSE 4 END"
#: The facts with annual figures of the last year too.
SQL_WHOLE_FACTS = SQL_FACTS.replace(_LAST_SQL, "4")

SQL_BARS = """
v_bars AS (
  SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS security_id, CAST(o_orderdate AS DATE) AS trade_date,
    first(o_totalprice ORDER BY o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
    first(o_totalprice ORDER BY o_orderkey DESC) AS close, count(*) AS volume, max(o_orderkey) AS source_id
  FROM orders GROUP BY ALL
  UNION ALL
  SELECT l_suppkey + 1000, CAST(l_shipdate AS DATE),
    first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice), max(l_extendedprice),
    min(l_extendedprice),
    first(l_extendedprice ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC), count(*),
    max(l_orderkey)
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"""

SQL_RAW_BARS = """
v_raw AS (
  SELECT l_suppkey + 1000 AS security_id, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice AS open,
    l_extendedprice * (1 + l_tax) AS high, l_extendedprice * (1 - l_discount) AS low,
    CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE l_extendedprice * 0.95::DOUBLE END AS close,
    CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT) AS volume,
    l_orderkey AS arrival, l_linenumber AS line_no, l_partkey AS partkey, l_extendedprice AS raw_price
  FROM lineitem)"""

SQL_SECURITIES = """
v_securities AS (
  SELECT sid AS security_id,
    CASE WHEN sid IN (1, 2) THEN '0000000001' WHEN sid = 3 THEN '0000000002' WHEN sid = 4 THEN '0000000003' END AS cik,
    upper(substr(p, 3, 3)) AS ticker, p AS name, 'NYSE' AS exchange, 'Technology' AS sector,
    'Semiconductors' AS industry, 'nasdaq' AS sector_source, '3674' AS sic, 'sec' AS sic_source
  FROM (SELECT DISTINCT o_orderpriority AS p, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS sid FROM orders)
  UNION ALL
  SELECT s_suppkey + 1000,
    CASE WHEN s_acctbal >= 0 THEN lpad(CAST(s_suppkey // 2 + 1000000 AS VARCHAR), 10, '0') END,
    'S' || s_suppkey, s_name, CASE WHEN s_acctbal > 5000 THEN 'NYSE' ELSE 'Nasdaq' END,
    CASE WHEN r_name = 'MIDDLE EAST' THEN 'N/A' ELSE r_name END,
    CASE WHEN r_name <> 'MIDDLE EAST' THEN n_name END, 'nasdaq',
    CASE WHEN r_name <> 'AFRICA' THEN CAST(n_nationkey + 3570 AS VARCHAR) END,
    CASE WHEN r_name <> 'AFRICA' THEN 'sec' END
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SQL_QUOTES = f"""
v_quote_days AS (
  SELECT security_id, min(trade_date) AS d0, max(trade_date) AS d1, first(close ORDER BY trade_date) AS c0,
    first(close ORDER BY trade_date DESC) AS c1, first(source_id ORDER BY trade_date DESC) AS source_id,
    max(high) FILTER (trade_date >= DATE '{AS_OF}' - 365) AS top
  FROM v_bars WHERE trade_date <= DATE '{AS_OF}' GROUP BY security_id),
v_quotes AS (
  SELECT security_id, source_id, d0 AS quote_date, c0 AS last_price, CASE WHEN c0 < 90000 THEN c0 * 1000 END AS market_cap,
    CAST(NULL AS DOUBLE) AS year_high FROM v_quote_days WHERE d0 <> d1
  UNION ALL
  SELECT security_id, source_id, d1, c1, CASE WHEN c1 < 90000 THEN c1 * 1000 END,
    CASE WHEN security_id = 3 THEN top * 1.01::DOUBLE ELSE top END FROM v_quote_days
    WHERE d0 <> d1 OR top IS NOT NULL)"""

SQL_SOURCES = """
v_sources AS (
  SELECT o_orderkey AS source_id,
    CASE o_orderstatus WHEN 'F' THEN 'sec' WHEN 'O' THEN 'nasdaq' ELSE 'cboe' END AS provider,
    CASE o_orderstatus WHEN 'F' THEN 'companyfacts' WHEN 'O' THEN 'equity.quote' ELSE 'equity.historical' END AS dataset,
    o_orderdate AS retrieved_at,
    'sha256:' || sha256(CAST(o_orderkey AS VARCHAR)) AS content_hash,
    CASE WHEN o_orderstatus = 'F' AND substr(o_orderpriority, 1, 1) = '4'
      THEN '{"notes": ["UNSUPPORTED_TAXONOMY:ifrs-full"]}' END AS detail,
    'GET' AS command,
    lpad(CAST(o_custkey + 1000000 AS VARCHAR), 10, '0') AS cik,
    '{"cik": "' || lpad(CAST(o_custkey + 1000000 AS VARCHAR), 10, '0') || '"}' AS parameters,
    CASE WHEN o_orderstatus <> 'P' THEN 'v1' END AS provider_version,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS as_of,
    substr(o_orderpriority, 1, 1) = '5' AS is_fallback
  FROM orders)"""

SQL_FILINGS = """
v_filings AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-01-000001' AS accession_no,
    lpad(CAST(o_custkey + 1000000 AS VARCHAR), 10, '0') AS cik, 'C' || o_custkey AS ticker,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '8-K' WHEN '2' THEN '10-Q' WHEN '3' THEN '4' WHEN '4' THEN 'SC 13G'
      ELSE 'S-1' END AS form,
    CAST(o_orderdate AS DATE) AS filing_date,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) - 30 END AS report_date,
    CASE WHEN o_orderstatus = 'F' THEN 'doc.htm' END AS primary_document,
    CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN
      CASE o_orderstatus WHEN 'F' THEN '2.02,9.01' WHEN 'O' THEN '1.01,5.02,1.02, 9.01' ELSE '9.01' END END AS items
  FROM orders)"""
