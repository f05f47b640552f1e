"""Ticker symbols in texts, by built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdsignal.sources.posts import symbols

#: Two to five capitals, with or without a dollar sign, that no letter, digit or underscore of any script follows. Nothing is
#: asked of what stands before.
CANDIDATE = r"\$?([A-Z]{2,5})(?![\p{L}\p{N}_])"

#: Capitals that are hardly ever meant as tickers.
BLACKLIST = """
AN OR AT TO IS OF IN IF BE AM AS DO GO UP US WE HE NO OK
ANY FOR NOT BUT CAN ONE TWO WAY NEW OUR OUT HOW WHY WHO HIS HER HAD
GET GOT OWN SEE USE PUT DAY END LOT MAY TOP BIG OFF MUCH MORE MOST SOME ONLY
JUST EVEN ALSO GOOD BEST MAKE SAID BACK OVER LIKE THAT THIS WITH WHAT WHEN
YEAR TIME NEXT LAST WEEK STILL GONNA WANNA DONT CANT WONT ISNT ITS HES SHES
DD IT COO
WSB YOLO FOMO EV OP PT ATH ATL ITM OTM IV HV SL TP CE PE MC CC HOLD
USD EUR GBP JPY CEO CFO CTO IPO ETF EPS PB ROE ROI ROIC FCF GDP CPI PPI
PMI FOMC FED SEC IRS IRA SSN LLC INC NYSE NASDAQ SPY QQQ DIA IWM VIX
FY Q1 Q2 Q3 Q4 H1 H2 YOY YTD MOM QOQ
JAN FEB MAR APR JUN JUL AUG SEP OCT DEC MON TUE WED THU FRI SAT SUN
LOL LMAO WTF OMG IMO IMHO TLDR AFAIK IIRC EDIT UPDATE NEWS POST LINK HERE REAL
""".split()


def candidates(text: Column) -> Column:
    """All matches of the pattern in order, repeats included; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(1)), F.array().cast("array<string>"))


def extract_tickers(text: Column, allowed: Column) -> Column:
    """The candidates that are allowed, each once, in the order of their first occurrence.

    ``array_intersect`` makes a set of its second array for every text. So the allowed symbols, which are many, are first held against the
    few candidates; the second step restores the order.
    """
    return _of_found(candidates(text), allowed)


def _of_found(found: Column, allowed: Column) -> Column:
    return F.array_intersect(found, F.array_intersect(allowed, found))


def allowed_symbols(tickers: DataFrame) -> Column:
    """The symbols of a table less the blacklist, as one array: a scalar subquery, computed by Spark."""
    found = symbols(tickers).where(~F.col("symbol").isin(BLACKLIST)).agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    return found.scalar()


def link_posts(posts: DataFrame, tickers: DataFrame) -> DataFrame:
    """Posts with at least one ticker, in the array column ``tickers``.

    A text is searched once: what was found is put out by an explode of one row to one, below which Spark doesn't push the filter
    with its expression.
    """
    allowed = allowed_symbols(tickers)
    searched = posts.withColumn("_found", F.explode_outer(F.array(candidates(F.col("text")))))
    return searched.where(F.arrays_overlap("_found", allowed)).withColumn("tickers", _of_found(F.col("_found"), allowed)).drop("_found")


def fan_out(linked: DataFrame) -> DataFrame:
    """One row per post and ticker; none for a post without.

    An inner explode would have Spark filter by the size of the array below, computing it twice.
    """
    return linked.withColumn("ticker", F.explode_outer("tickers")).where("ticker IS NOT NULL").drop("tickers")
