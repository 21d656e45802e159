"""Position sizes, allocation, simulated execution and risk limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import EPS


def kelly(win_rate: Column, avg_win: Column, avg_loss: Column) -> Column:
    """(p W - (1 - p) L) / W, not below 0; 0 unless L is positive."""
    return F.when(avg_loss > 0, F.greatest(F.lit(0.0), F.try_divide(win_rate * avg_win - (1.0 - win_rate) * avg_loss, avg_win))).otherwise(0.0)


def _within(x: Column, low: float, high: float) -> Column:
    """Between the two; NULL stays NULL, which least() and greatest() pass over."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


@dataclass
class Allocator:
    max_position: float = 0.1
    kelly_fraction: float = 0.25
    volatility_target: float = 0.15
    leverage_limit: float = 2.0

    def volatility_size(self, volatility: Column) -> Column:
        return F.when(volatility > 0, F.least(F.lit(self.volatility_target) / volatility, F.lit(self.leverage_limit))).otherwise(0.0)

    def size(self, signal: Column, confidence: Column, volatility: Column, win_rate: Column | None = None, avg_win: Column | None = None, avg_loss: Column | None = None) -> Column:
        """The signal's direction times the least of strength, Kelly and volatility sizes, within the limit.

        Without a signal or a confidence there is no size: NULL.
        """
        base = F.abs(signal) * confidence
        sizes = [base, self.volatility_size(volatility)]
        if win_rate is not None and avg_win is not None and avg_loss is not None:
            sizes.append(F.coalesce(kelly(win_rate, avg_win, avg_loss) * self.kelly_fraction, base))
        return F.signum(signal) * _within(F.when(base.isNotNull(), F.least(*sizes)), 0.0, self.max_position)

    def allocate(self, assets: DataFrame, method: str = "risk_parity", by: tuple[str, ...] = ("ts",)) -> DataFrame:
        """assets (asset, signal, and volatility or confidence) with allocation; an asset without a volatility gets 0."""
        w = Window.partitionBy(*by)
        way = F.signum("signal")
        if method == "risk_parity":
            inverse = 1.0 / (F.col("volatility") + EPS)
            weight = F.coalesce(F.try_divide(inverse, F.sum(inverse).over(w)), F.lit(0.0))
        elif method == "equal_weight":
            weight = F.lit(1.0) / F.count(F.lit(1)).over(w)
        elif method == "signal_weight":
            own = F.abs("signal") * F.coalesce(F.col("confidence"), F.lit(1.0))
            weight = F.coalesce(F.try_divide(own, F.sum(own).over(w)), F.lit(0.0))
        else:
            raise ValueError(f"unknown method: {method}")
        return assets.withColumn("allocation", way * weight)

    def limited(self, targets: DataFrame, current: DataFrame | None = None, max_turnover: float = 0.5, by: tuple[str, ...] = ("ts",)) -> DataFrame:
        """by, asset, allocation within limits of position, leverage and turnover, in this order.

        Assets that are only held count for turnover and aren't traded.  A NULL
        allocation stays NULL and is no part of the gross; beside ``current`` it is 0.
        """
        w = Window.partitionBy(*by)
        out = targets.select(*by, "asset", _within(F.col("allocation"), -self.max_position, self.max_position).alias("allocation"))
        gross = F.sum(F.abs("allocation")).over(w)
        out = out.withColumn("_g", gross).withColumn("allocation", F.col("allocation") * F.when(F.col("_g") > self.leverage_limit, F.lit(self.leverage_limit) / F.col("_g")).otherwise(1.0)).drop("_g")
        if current is None:
            return out
        held = current.select(*by, "asset", F.col("position").alias("_held"))
        both = out.withColumn("_own", F.lit(True)).join(held, [*by, "asset"], "full_outer")
        move = F.coalesce("allocation", F.lit(0.0)) - F.coalesce("_held", F.lit(0.0))
        both = both.withColumn("_t", F.sum(F.abs(move)).over(w))
        scale = F.when(F.col("_t") > max_turnover, F.lit(max_turnover) / F.col("_t")).otherwise(1.0)
        at = F.coalesce("_held", F.lit(0.0)) + move * scale
        return both.withColumn("allocation", at).filter("_own").select(*by, "asset", "allocation")


@dataclass
class Execution:
    commission_rate: float = 0.001
    slippage_rate: float = 0.0005
    min_commission: float = 1.0
    least_signal: float = 0.01
    least_change: float = 0.01

    def trades(self, orders: DataFrame) -> DataFrame:
        """ts, symbol, side, quantity, price, commission, slippage, total_cost of orders (ts, symbol, signal, price, portfolio_value, position_size).

        Weak signals trade nothing.  The price has slipped, and total_cost adds the
        slippage once more.
        """
        buys = F.col("signal") > 0
        quantity = F.try_divide(F.col("portfolio_value") * F.abs("position_size"), F.col("price"))
        out = orders.filter(F.abs("signal") >= self.least_signal).withColumn("quantity", quantity)
        value = F.col("quantity") * F.col("price")
        paid = F.col("price") * F.when(buys, 1 + self.slippage_rate).otherwise(1 - self.slippage_rate)
        out = out.withColumns({"side": F.when(buys, "buy").otherwise("sell"), "commission": F.greatest(value * self.commission_rate, F.lit(self.min_commission)), "slippage": value * self.slippage_rate, "_paid": paid})
        total = F.col("quantity") * F.col("_paid") + F.col("commission") + F.col("slippage")
        return out.select("ts", "symbol", "side", "quantity", F.col("_paid").alias("price"), "commission", "slippage", total.alias("total_cost"))

    def rebalance(self, current: DataFrame, target: DataFrame, prices: DataFrame, value: float | Column) -> DataFrame:
        """Trades from positions (ts, symbol, position) to targets (ts, symbol, position) at prices (ts, symbol, price)."""
        a = current.select("ts", "symbol", F.col("position").alias("_from"))
        b = target.select("ts", "symbol", F.col("position").alias("_to"))
        change = F.coalesce("_to", F.lit(0.0)) - F.coalesce("_from", F.lit(0.0))
        moved = a.join(b, ["ts", "symbol"], "full_outer").withColumn("_c", change).filter(F.abs("_c") > self.least_change)
        priced = moved.join(prices.select("ts", "symbol", "price"), ["ts", "symbol"]).filter("price > 0")
        value = value if isinstance(value, Column) else F.lit(float(value))
        return self.trades(priced.select("ts", "symbol", F.signum("_c").alias("signal"), "price", value.alias("portfolio_value"), F.abs("_c").alias("position_size")))

    @staticmethod
    def stats(trades: DataFrame) -> DataFrame:
        """One row: num_trades, totals and means of commission and slippage, total_cost (missing without trades)."""
        c, s, zero = F.sum("commission"), F.sum("slippage"), F.lit(0.0)
        return trades.agg(F.count(F.lit(1)).alias("num_trades"), F.coalesce(c, zero).alias("total_commission"), F.coalesce(s, zero).alias("total_slippage"), F.coalesce(F.avg("commission"), zero).alias("avg_commission"), F.coalesce(F.avg("slippage"), zero).alias("avg_slippage"), (c + s).alias("total_cost"))


@dataclass
class Risk:
    max_position: float = 0.1
    max_leverage: float = 2.0
    max_drawdown: float = 0.2
    max_concentration: float = 0.3
    stop_loss: float = 0.05
    take_profit: float = 0.10

    def positions(self, positions: DataFrame, by: tuple[str, ...] = ("ts",)) -> DataFrame:
        """positions (asset, position) with position_ok, and leverage and leverage_ok of all at a time."""
        gross = F.sum(F.abs("position")).over(Window.partitionBy(*by))
        return positions.withColumns({"position_ok": F.abs("position") <= self.max_position, "leverage": gross, "leverage_ok": gross <= self.max_leverage})

    def drawdown(self, values: DataFrame) -> DataFrame:
        """values (symbol, ts, value) with peak, drawdown, drawdown_ok and breached, which stays once set."""
        upto = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        out = values.withColumn("peak", F.greatest(F.max("value").over(upto), F.lit(0.0)))
        out = out.withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col("value")) / F.col("peak")).otherwise(0.0))
        out = out.withColumn("drawdown_ok", F.col("drawdown") <= self.max_drawdown)
        return out.withColumn("breached", F.max(~F.col("drawdown_ok")).over(upto))

    def concentration(self, positions: DataFrame, groups: DataFrame | None = None, by: tuple[str, ...] = ("ts",)) -> DataFrame:
        """by, concentration (the largest group's exposure, or the largest position), concentration_ok."""
        if groups is None:
            sized = positions.withColumn("_e", F.abs("position"))
        else:
            grouped = positions.join(groups.select("asset", "group"), "asset", "left").withColumn("group", F.coalesce("group", F.lit("unknown")))
            sized = grouped.groupBy(*by, "group").agg(F.sum(F.abs("position")).alias("_e"))
        return sized.groupBy(*by).agg(F.max("_e").alias("concentration")).withColumn("concentration_ok", F.col("concentration") <= self.max_concentration)

    def exits(self, entry: Column, price: Column, side: Column) -> Column:
        """stop_loss, take_profit or NULL for a long or short position."""
        gain = F.when(side == "long", F.try_divide(price - entry, entry)).when(side == "short", F.try_divide(entry - price, entry))
        return F.when(gain <= -self.stop_loss, "stop_loss").when(gain >= self.take_profit, "take_profit")

    def validated(self, positions: DataFrame, values: DataFrame, by: tuple[str, ...] = ("ts",)) -> DataFrame:
        """positions with trade_ok: position, leverage and drawdown (of ts, drawdown_ok) all hold."""
        checked = self.positions(positions, by).join(values.select(*by, "drawdown_ok"), list(by), "left")
        return checked.withColumn("trade_ok", F.col("position_ok") & F.col("leverage_ok") & F.coalesce("drawdown_ok", F.lit(True)))
