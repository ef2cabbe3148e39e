"""Row-wise functions over events: x is the value, scaled to about -5 to 44; y = sigmoid(x) where a gradient takes an output."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenark.functions import scalar as S
from lumenark.plans.kit import Query, rows

_X = "(value / 10 - 5)"
_SIG = f"(CASE WHEN {_X} < -20 THEN exp({_X}) / (1 + exp({_X})) ELSE 1 / (1 + exp(-{_X})) END)"


def _x():
    return F.col("value") / 10 - 5


def _sig(z: str) -> str:
    return f"(CASE WHEN {z} < -20 THEN exp({z}) / (1 + exp({z})) ELSE 1 / (1 + exp(-({z}))) END)"


_B = 0.5
_TABLE: dict[str, tuple] = {
    "act_sigmoid": (lambda: S.sigmoid(_x()), _SIG),
    "act_sigmoid_gradient": (lambda: S.sigmoid_gradient(S.sigmoid(_x())), f"{_SIG} * (1 - {_SIG})"),
    "act_hard_sigmoid": (lambda: S.hard_sigmoid(_x()), f"greatest(least({_X} * 0.25 + 0.5, 1), 0)"),
    "act_hard_sigmoid_gradient": (lambda: S.hard_sigmoid_gradient(S.hard_sigmoid(_x())), f"CASE WHEN {_X} * 0.25 + 0.5 > 0 AND {_X} * 0.25 + 0.5 < 1 THEN 0.25 ELSE 0 END"),
    "act_tanh": (lambda: F.tanh(_x()), f"tanh({_X})"),
    "act_tanh_gradient": (lambda: S.tanh_gradient(F.tanh(_x())), f"1 - tanh({_X}) * tanh({_X})"),
    "act_hard_tanh": (lambda: S.hard_tanh(_x()), f"greatest(least({_X}, 1), -1)"),
    "act_hard_tanh_gradient": (lambda: S.hard_tanh_gradient(S.hard_tanh(_x())), f"CASE WHEN {_X} > -1 AND {_X} < 1 THEN 1 ELSE 0 END"),
    "act_relu": (lambda: S.relu(_x()), f"greatest({_X}, 0)"),
    "act_relu_gradient": (lambda: S.relu_gradient(_x()), f"CASE WHEN {_X} > 0 THEN 1 ELSE 0 END"),
    "act_prelu": (lambda: S.prelu(_x(), _B), f"greatest({_X}, 0) + {_B} * least({_X}, 0)"),
    "act_prelu_gradient": (lambda: S.prelu_gradient(_x(), _B), f"CASE WHEN {_X} > 0 THEN 1 ELSE {_B} END"),
    "act_prelu_slope_gradient": (lambda: S.prelu_slope_gradient(_x()), f"CASE WHEN {_X} <= 0 THEN {_X} ELSE 0 END"),
    "act_softplus": (lambda: S.softplus(_x()), f"CASE WHEN {_X} > 20 THEN {_X} ELSE ln(1 + exp(least({_X}, 20))) END"),
    "act_softplus_gradient": (lambda: S.softplus_gradient(_x()), f"CASE WHEN {_X} > 20 THEN 1 ELSE {_SIG} END"),
    "act_swish": (lambda: S.swish(_x(), _B), f"{_X} * {_sig(f'{_B} * {_X}')}"),
    "act_swish_gradient": (lambda: S.swish_gradient(_x(), _B), f"{_sig(f'{_B} * {_X}')} + {_B} * {_X} * {_sig(f'{_B} * {_X}')} * (1 - {_sig(f'{_B} * {_X}')})"),
    "act_swish_slope_gradient": (lambda: S.swish_slope_gradient(_x(), _B), f"({_X} - {_X} * {_sig(f'{_B} * {_X}')}) * {_X} * {_sig(f'{_B} * {_X}')}"),
    "act_silu": (lambda: S.swish(_x()), f"{_X} * {_SIG}"),
    "act_gelu": (lambda: S.gelu(_x()), f"0.5 * {_X} * (1 + tanh({math.sqrt(2 / math.pi)!r} * ({_X} + 0.044715 * {_X} * {_X} * {_X})))"),
    "act_clip": (lambda: S.clip(_x(), -2.0, 3.0), f"least(greatest({_X}, -2), 3)"),
    "basis_truncated_power": (lambda: S.truncated_power(_x(), 1.5, 3), f"CASE WHEN {_X} > 1.5 THEN pow({_X} - 1.5, 3) ELSE 0 END"),
    "basis_polynomial": (lambda: _x() + F.pow(_x(), F.lit(2)) + F.pow(_x(), F.lit(3)), f"{_X} + pow({_X}, 2) + pow({_X}, 3)"),
    "basis_step": (lambda: sum((F.when((_x() > a) & (_x() <= b), i).otherwise(0) for i, (a, b) in enumerate([(-4.0, -2.0), (-2.0, 0.0), (0.0, 1e9)], 1)), F.lit(0)).cast("double"), f"CASE WHEN {_X} > 0 THEN 3 WHEN {_X} > -2 THEN 2 WHEN {_X} > -4 THEN 1 ELSE 0 END"),
    "basis_regression_spline": (lambda: _x() + F.pow(_x(), F.lit(2)) + F.pow(_x(), F.lit(3)) + S.truncated_power(_x(), 0.0, 3) + S.truncated_power(_x(), 5.0, 3), f"{_X} + pow({_X}, 2) + pow({_X}, 3) + CASE WHEN {_X} > 0 THEN pow({_X}, 3) ELSE 0 END + CASE WHEN {_X} > 5 THEN pow({_X} - 5, 3) ELSE 0 END"),
    "optim_sgd": (lambda: S.sgd(_x(), F.col("value"), 0.01), f"{_X} - 0.01 * value"),
    "optim_momentum": (lambda: S.momentum(_x(), F.col("value"), F.lit(0.5), 0.01), f"{_X} - 0.01 * (0.9 * 0.5 + value)"),
    "optim_adagrad": (lambda: S.adagrad(_x(), F.col("value"), F.lit(0.25), 0.01), f"{_X} - 0.01 * value / (sqrt(0.25 + value * value) + 1e-8)"),
    "optim_rmsprop": (lambda: S.rmsprop(_x(), F.col("value"), F.lit(0.25), 0.01), f"{_X} - 0.01 * value / (sqrt(0.9 * 0.25 + 0.1 * value * value) + 1e-8)"),
    "optim_adadelta": (lambda: S.adadelta(_x(), F.col("value"), F.lit(0.25), F.lit(0.04)), f"{_X} - value * sqrt(0.04 + 1e-8) / sqrt(0.9 * 0.25 + 0.1 * value * value + 1e-8)"),
    "optim_adam": (lambda: S.adam(_x(), F.col("value"), F.lit(0.5), F.lit(0.25), 3, 0.01), f"{_X} - 0.01 * ((0.9 * 0.5 + 0.1 * value) / (1 - pow(0.9, 3))) / (sqrt((0.999 * 0.25 + 0.001 * value * value) / (1 - pow(0.999, 3))) + 1e-8)"),
    "optim_yogi": (lambda: S.adam(_x(), F.col("value"), F.lit(0.5), F.lit(0.25), 3, 0.01, yogi=True), f"{_X} - 0.01 * ((0.9 * 0.5 + 0.1 * value) / (1 - pow(0.9, 3))) / (sqrt((0.25 + 0.001 * value * value * sign(value * value - 0.25)) / (1 - pow(0.999, 3))) + 1e-8)"),
    "optim_adamw": (lambda: S.adam(_x(), F.col("value"), F.lit(0.5), F.lit(0.25), 3, 0.01, decay=0.01), f"{_X} - 0.01 * ((0.9 * 0.5 + 0.1 * value) / (1 - pow(0.9, 3))) / (sqrt((0.999 * 0.25 + 0.001 * value * value) / (1 - pow(0.999, 3))) + 1e-8) - 0.01 * 0.01 * {_X}"),
    "optim_ema": (lambda: 0.99 * _x() + 0.01 * F.col("value"), f"0.99 * {_X} + 0.01 * value"),
    "optim_swa": (lambda: _x() + (F.col("value") - _x()) / 4, f"{_X} + (value - {_X}) / 4"),
    "reg_l1": (lambda: S.elastic(_x(), 0.01, 1.0), f"0.01 * sign({_X})"),
    "reg_l2": (lambda: S.elastic(_x(), 0.01, 0.0), f"0.01 * {_X}"),
    "reg_elastic": (lambda: S.elastic(_x()), f"0.01 * (0.5 * sign({_X}) + 0.5 * {_X})"),
    "reg_l1_decay": (lambda: _x() - 0.1 * S.elastic(_x(), 0.01, 1.0), f"{_X} - 0.1 * 0.01 * sign({_X})"),
    "reg_l2_decay": (lambda: _x() - 0.1 * S.elastic(_x(), 0.01, 0.0), f"{_X} - 0.1 * 0.01 * {_X}"),
    "reg_elastic_decay": (lambda: _x() - 0.1 * S.elastic(_x()), f"{_X} - 0.1 * 0.01 * (0.5 * sign({_X}) + 0.5 * {_X})"),
    "loss_bce_gradient": (lambda: S.sigmoid(_x()) - (F.col("event_type") == "click").cast("double"), f"{_SIG} - CASE WHEN event_type = 'click' THEN 1 ELSE 0 END"),
    "iforest_average_path": (lambda: F.when(F.col("user_id") < 2, 0.0).when(F.col("user_id") == 2, 1.0).otherwise(2 * (F.log(F.greatest(F.col("user_id") - 1.0, F.lit(1.0))) + 0.5772156649015329) - 2 * (F.col("user_id") - 1) / F.greatest(F.col("user_id").cast("double"), F.lit(1.0))), "CASE WHEN user_id < 2 THEN 0 WHEN user_id = 2 THEN 1 ELSE 2 * (ln(greatest(user_id - 1.0, 1)) + 0.5772156649015329) - 2 * (user_id - 1) / greatest(user_id::DOUBLE, 1) END"),
    "iforest_score": (lambda: F.pow(F.lit(2.0), -F.col("value") / 10.24), "pow(2.0, -value / 10.24)"),
    "gmm_logpdf": (lambda: F.log(F.greatest(0.4 * F.exp(-F.pow((F.col("value") - 20) / 15, F.lit(2)) / 2) / (15 * math.sqrt(2 * math.pi)) + 0.6 * F.exp(-F.pow((F.col("value") - 90) / 60, F.lit(2)) / 2) / (60 * math.sqrt(2 * math.pi)), F.lit(1e-100))), f"ln(greatest(0.4 * exp(-pow((value - 20) / 15, 2) / 2) / {15 * math.sqrt(2 * math.pi)!r}::DOUBLE + 0.6 * exp(-pow((value - 90) / 60, 2) / 2) / {60 * math.sqrt(2 * math.pi)!r}::DOUBLE, 1e-100))"),
}
_E = "(event_id % 12)"


def _e():
    return F.col("event_id") % 12


_RATES: dict[str, tuple] = {
    "lr_constant": (lambda: F.lit(0.1), "0.1"),
    "lr_linear": (lambda: S.linear_rate(_e(), 0.1), f"0.1 * (0.2 + 0.8 * least(greatest({_E}, 0), 5) / 5)"),
    "lr_multi_step": (lambda: S.multi_step_rate(_e(), 0.1, [3, 6, 9]), f"0.1 * pow(0.5, CASE WHEN {_E} >= 9 THEN 3 WHEN {_E} >= 6 THEN 2 WHEN {_E} >= 3 THEN 1 ELSE 0 END)"),
    "lr_cosine": (lambda: S.cosine_rate(_e(), 0.1, 0.001, 0, 10), f"0.001 + 0.099 * 0.5 * (1 + cos(pi() * least({_E}, 10) / 10))"),
    "lr_cyclic": (lambda: S.cosine_rate(_e() % 4, 0.1, 0.001, 0, 4), f"0.001 + 0.099 * 0.5 * (1 + cos(pi() * ({_E} % 4) / 4))"),
    "lr_aggregate": (lambda: F.when(_e() < 5, S.linear_rate(_e(), 0.1)).otherwise(S.cosine_rate(_e(), 0.1, 0.001, 5, 12)), f"CASE WHEN {_E} < 5 THEN 0.1 * (0.2 + 0.8 * {_E} / 5) ELSE 0.001 + 0.099 * 0.5 * (1 + cos(pi() * ({_E} - 5) / 7)) END"),
    "lr_root": (lambda: S.root_rate(_e(), 0.1), f"0.1 / sqrt({_E} + 1.0)"),
    "conv_same_padding": (lambda: S.conv_same_padding(F.col("user_id"), 5, 2, 3).cast("double"), "user_id * 1 + 3 * 4 + 1 - 2"),
    "conv_output_size": (lambda: S.conv_output_size(F.col("user_id") + 10, 5, 2, 1).cast("double"), "floor((user_id + 10 + 1 - 5) / 2) + 1"),
}
QUERIES: dict[str, Query] = {n: rows("events", ["event_id"], f) for n, (f, _) in (_TABLE | _RATES).items()}
SQL: dict[str, str] = {n: f"SELECT event_id, round(({s})::DOUBLE, 9) + 0.0::DOUBLE AS y FROM events" for n, (_, s) in (_TABLE | _RATES).items()}
