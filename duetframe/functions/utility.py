"""Utilities, weights, incentives and losses as columns of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FollowerConfig, IncentiveConfig, UtilityConfig


def clamp(x: Column, low: float, high: float) -> Column:
    """Between low and high; null counts as 0, as least() and greatest() would let it pass for the limit."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x.cast("double"), F.lit(0.0))))


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def total_cost(rounds: Column, tokens: Column, cfg: UtilityConfig) -> Column:
    return F.lit(cfg.lambda_round) * rounds + F.lit(cfg.lambda_token) * tokens


def leader_utility(pass_rate: Column, rounds: Column, tokens: Column, cfg: UtilityConfig, incentive: Column | None = None, penalty: Column | None = None) -> Column:
    zero = F.lit(0.0)
    return clamp01(pass_rate) - total_cost(rounds, tokens, cfg) - (zero if incentive is None else incentive) - (zero if penalty is None else penalty)


def token_base(mode: str, context: Column, communication: Column) -> Column:
    """What tokens a plan is charged for; an unknown mode is refused."""
    modes = {"outputs_only": communication, "context_and_outputs": context + communication}
    if mode not in modes:
        raise ValueError(f"unknown token mode {mode}")
    return modes[mode]


def follower_utility(pass_rate: Column, tokens: Column, incentive: Column, cfg: UtilityConfig) -> Column:
    return clamp01(pass_rate) + incentive - F.lit(cfg.lambda_token) * tokens


def step_incentive(pass_rate: Column, best_before: Column, budget: Column, max_step: Column) -> Column:
    return F.least(max_step, budget * F.greatest(F.lit(0.0), clamp01(pass_rate) - best_before))


def candidate_utility(pass_rate: Column, best_before: Column, code_tokens: Column, budget: Column, max_step: Column, cfg: FollowerConfig) -> Column:
    gain = F.greatest(F.lit(0.0), clamp01(pass_rate) - best_before)
    return cfg.beta_pass * clamp01(pass_rate) + cfg.beta_delta * gain - cfg.lambda_token * code_tokens + step_incentive(pass_rate, best_before, budget, max_step)


def reward_utility(pass_rate: Column, best_before: Column, code_tokens: Column, incentive: Column, cfg: FollowerConfig) -> Column:
    """As candidate_utility with an incentive given, the pass rate not clamped and a missing one worth nothing."""
    reward = cfg.beta_pass * pass_rate + cfg.beta_delta * F.greatest(F.lit(0.0), pass_rate - best_before)
    return F.coalesce(reward, F.lit(0.0)) - cfg.lambda_token * code_tokens + incentive


def efficiency(seconds: Column, timeout: Column) -> Column:
    """0 without a run or after a timeout, else nearer to 1 the quicker the run."""
    return F.when(seconds.isNull() | timeout, 0.0).otherwise(1.0 / (1.0 + F.greatest(F.lit(0.0), seconds)))


def budget(estimate: Column, cfg: IncentiveConfig = IncentiveConfig()) -> Column:
    """struct<normalized, multiplier, budget> of an effort estimate in tokens."""
    normalized = clamp((estimate - cfg.reference) / max(1.0, cfg.scale), -3.0, 3.0)
    multiplier = clamp(F.exp(cfg.gamma * normalized), 1.0 / cfg.max_multiplier, cfg.max_multiplier)
    return F.struct(normalized.alias("normalized"), multiplier.alias("multiplier"), clamp(cfg.base * multiplier, cfg.least, cfg.most).alias("budget"))


def static_estimate(prompt_tokens: Column, test_tokens: Column, low: int = 80, high: int = 800, whole: bool = True) -> Column:
    """Effort by the task alone; whole: cut to an integer (sampling), else not (evaluation)."""
    got = clamp(prompt_tokens + 0.25 * test_tokens, low, high)
    return got.cast("int") if whole else got


def calibrated_estimate(stated: Column, plan_tokens: Column, prompt_tokens: Column, test_tokens: Column, low: int = 80, high: int = 800) -> Column:
    """The effort that a plan states, but no less than its own length asks for."""
    floor = (plan_tokens + 0.25 * prompt_tokens + 0.10 * test_tokens).cast("int")
    return clamp(F.greatest(F.coalesce(stated, F.lit(0)), floor), low, high).cast("int")


def raw_weight(delta: Column, mean: Column) -> Column:
    return delta / (mean + 1e-8)


def weight(delta: Column, mean: Column, cfg: UtilityConfig = UtilityConfig()) -> Column:
    return clamp(F.pow(raw_weight(delta, mean), cfg.weight_power), cfg.weight_min, cfg.weight_max)


def approx_tokens(text: Column, chars_per_token: float = 4.0) -> Column:
    if chars_per_token <= 0:
        raise ValueError("chars_per_token must be positive")
    return F.coalesce(F.ceil(F.length(text) / chars_per_token), F.lit(0)).cast("int")


def sequence_logprob(logps: Column, mask: Column, normalize: bool) -> Column:
    """Sum (or mean over the masked places) of token log-probabilities held in arrays."""
    total = F.aggregate(F.zip_with(logps, mask, lambda p, m: p * m), F.lit(0.0), lambda a, x: a + x)
    n = F.aggregate(mask, F.lit(0.0), lambda a, x: a + x)
    return total / F.greatest(F.lit(1.0), n) if normalize else total


def dpo_logits(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float) -> Column:
    return beta * ((policy_chosen - policy_rejected) - (ref_chosen - ref_rejected))


def dpo_loss(logits: Column) -> Column:
    """-log(sigmoid(z)) without overflow on either side."""
    return F.log1p(F.exp(-F.abs(logits))) + F.greatest(-logits, F.lit(0.0))


def budget_allocation(method: Column, budget_col: Column) -> Column:
    """struct<max_new, plan>: how a token budget is dealt to the generations of a method."""
    third, half = F.floor(budget_col / 3), F.floor(budget_col / 2)
    plan = F.least(F.lit(384), F.greatest(F.lit(64), F.bround(budget_col * 0.2)))
    most = F.when(method == "self_consistency_3", F.greatest(F.lit(64), third)).when(method == "self_repair", F.greatest(F.lit(64), half))
    most = most.when(method == "agentcoder", F.greatest(F.lit(64), F.floor((budget_col - plan) / 2))).otherwise(budget_col)
    return F.struct(most.cast("int").alias("max_new"), F.when(method == "agentcoder", plan).otherwise(64).cast("int").alias("plan"))
