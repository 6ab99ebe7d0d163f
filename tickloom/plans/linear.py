"""Linear models solved on the driver from collected moments (p x p systems only)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from tickloom.plans.moments import ONE, Y_SQUARED, Moments, abs_power

# Ridge strength of the standardised model, scale and deviation floors.
STANDARDISED_ALPHA = 2000.0
FLOOR = 1e-6


@dataclass
class Fit:
    """Prediction = intercept + coef . x on raw features, with a constant or a feature-driven uncertainty."""

    intercept: float
    coef: np.ndarray
    residual_std: float | None = None
    unc_intercept: float | None = None
    unc_coef: np.ndarray | None = None
    unc_floor: float = FLOOR

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + x @ self.coef

    def uncertainty(self, x: np.ndarray) -> np.ndarray:
        if self.unc_coef is None:
            return np.full(len(x), np.nan if self.residual_std is None else self.residual_std)
        with np.errstate(over="ignore"):
            u = np.expm1(self.unc_intercept + x @ self.unc_coef)
        u = np.where(np.isfinite(u), u, self.residual_std)
        return np.maximum(u, self.unc_floor)

    def widened(self, columns: Sequence[int], p: int, blanked: Sequence[int] = ()) -> "Fit":
        """The same fit over p columns; coefficients outside `columns`, or blanked, are 0."""

        def spread(c: np.ndarray | None) -> np.ndarray | None:
            if c is None:
                return None
            wide = np.zeros(p)
            wide[list(columns)] = c
            wide[list(blanked)] = 0.0
            return wide

        return Fit(
            self.intercept, spread(self.coef), self.residual_std, self.unc_intercept, spread(self.unc_coef), self.unc_floor
        )


def _solve(lhs: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    try:
        out = np.linalg.solve(lhs, rhs)
    except np.linalg.LinAlgError:
        out = None
    if out is None or not np.all(np.isfinite(out)):
        raise ValueError("The normal equations are singular; drop constant or repeated features or raise alpha.")
    return out


def standard_scale(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Train mean (relative to the shift) and population std with its floor."""
    mean = m.matrix[0, 1:-1] / m.weight
    var = np.diag(m.matrix)[1:-1] / m.weight - mean * mean
    std = np.sqrt(np.maximum(var, 0.0))
    return mean, np.where(std > FLOOR, std, 1.0)


def standardised_ridge(m: Moments, alpha: float = STANDARDISED_ALPHA) -> Fit:
    """(Z'Z + alpha I) b = Z'(y - mean y) on z-scores; intercept mean y. Uncertainty comes from a second pass."""
    n = m.weight
    mean, scale = standard_scale(m)
    y_mean = m.matrix[0, -1] / n
    gram = (m.matrix[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(scale, scale)
    cross = (m.matrix[1:-1, -1] - n * mean * y_mean) / scale
    beta = _solve(gram + alpha * np.eye(len(mean)), cross) if len(mean) else np.zeros(0)
    coef = beta / scale
    intercept = y_mean - float(coef @ (m.shift + mean))
    return Fit(intercept, coef, residual_std=_residual_std(m, intercept, coef))


def _residual_sums(m: Moments, intercept: float, coef: np.ndarray) -> tuple[float, float, float]:
    """Weighted sums of 1, r and r^2 for r = y - prediction, from the moments alone."""
    r = np.concatenate([[-(intercept + float(coef @ m.shift))], -coef, [1.0]])
    return m.weight, float(m.matrix[0] @ r), float(r @ m.matrix @ r)


def _residual_std(m: Moments, intercept: float, coef: np.ndarray) -> float:
    n, s, q = _residual_sums(m, intercept, coef)
    var = (q - s * s / n) / (n - 1) if n > 1 else 0.0
    return max(float(np.sqrt(max(var, 0.0))), FLOOR)


def raw_ridge(m: Moments, alpha: float = 1.0) -> Fit:
    """(D'D + alpha P) c = D'y with D = (1, x) and the intercept unpenalised; constant uncertainty."""
    d = m.matrix[:-1, :-1]
    penalty = alpha * np.eye(len(d))
    penalty[0, 0] = 0.0
    c = _solve(d + penalty, m.matrix[:-1, -1])
    coef = c[1:]
    intercept = float(c[0] - coef @ m.shift)
    return Fit(intercept, coef, residual_std=_residual_std(m, intercept, coef))


def weighted_ridge(m: Moments, alpha: float = 1.0) -> Fit:
    """Raw ridge under weights scaled to mean 1 over the rows; weighted population residual deviation."""
    mean_weight = m.weight / m.n if m.n else 1.0
    scaled = Moments(m.matrix / mean_weight, m.shift, m.n)
    d = scaled.matrix[:-1, :-1]
    penalty = alpha * np.eye(len(d))
    penalty[0, 0] = 0.0
    c = _solve(d + penalty, scaled.matrix[:-1, -1])
    coef = c[1:]
    intercept = float(c[0] - coef @ m.shift)
    w, s, q = _residual_sums(scaled, intercept, coef)
    std = float(np.sqrt(max(q / w - (s / w) ** 2, 0.0)))
    return Fit(intercept, coef, residual_std=max(std, FLOOR))


def max_sharpe(m: Moments, y2: Moments, penalty: float = 0.0) -> Fit:
    """Linear position with the largest in-sample Sharpe: w ∝ (Cov(z) + penalty I)^-1 mean(z), z = y (1, x_std).

    Features are standardised first, so the penalty means the same for every column.
    """
    mean, scale = standard_scale(m)
    n = m.weight
    basis = _standardiser(mean, scale)
    z_mean = basis @ m.matrix[:-1, -1] / n
    second = basis @ y2.matrix[:-1, :-1] @ basis.T / n
    cov = second - np.outer(z_mean, z_mean)
    w = _solve(cov + penalty * np.eye(len(cov)), z_mean)
    coef = w[1:] / scale
    return Fit(float(w[0] - coef @ (m.shift + mean)), coef)


def _standardiser(mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Matrix taking (1, x - shift) to (1, z-scores)."""
    b = np.diag(np.concatenate([[1.0], 1.0 / scale]))
    b[1:, 0] = -mean / scale
    return b


def position_sharpe(fit: Fit, m: Moments, y2: Moments, annualization: float = 16.0) -> float:
    """Sharpe of position = prediction, from the moments: no row is scored."""
    c = np.concatenate([[fit.intercept + float(fit.coef @ m.shift)], fit.coef])
    n = m.weight
    mean = float(c @ m.matrix[:-1, -1]) / n
    var = float(c @ y2.matrix[:-1, :-1] @ c) / n - mean * mean
    std = np.sqrt(max(var, 0.0))
    return mean / std * annualization if std > 0 and np.isfinite(std) else 0.0


def uncertainty_ridge(fit: Fit, m: Moments, t_sum: float, xt_sum: np.ndarray, floor: float, alpha: float) -> Fit:
    """Add the feature-driven uncertainty: a ridge of t = ln(1+|r|) on the same z-scores.

    `t_sum` and `xt_sum` are sums of t and of (x - shift) t over the train rows, `floor` the 0.1 quantile of |r|.
    """
    n = m.weight
    mean, scale = standard_scale(m)
    gram = (m.matrix[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(scale, scale)
    cross = (xt_sum - mean * t_sum) / scale
    beta = _solve(gram + alpha * np.eye(len(mean)), cross) if len(mean) else np.zeros(0)
    coef = beta / scale
    return Fit(
        fit.intercept,
        fit.coef,
        fit.residual_std,
        unc_intercept=t_sum / n - float(coef @ (m.shift + mean)),
        unc_coef=coef,
        unc_floor=max(floor, FLOOR),
    )


@dataclass(frozen=True)
class Model:
    """A model: the weight kinds its moments need and its solver, by name or given by the caller.

    A caller's `solver` takes (params, one Moments for each of `moment_kinds`) and returns a Fit.
    """

    name: str
    params: dict = field(default_factory=dict)
    solver: Callable[..., Fit] | None = None
    moment_kinds: tuple[tuple[str, float, float], ...] = (ONE,)

    def kinds(self) -> list[tuple[str, float, float]]:
        if self.solver:
            return list(self.moment_kinds)
        if self.name in ("weighted_linear", "weighted_ridge"):
            return [abs_power(self.params.get("weight_power", 1.0), self.params.get("min_weight", 0.25))]
        if self.name == "max_sharpe":
            return [ONE, Y_SQUARED]
        return [ONE]

    def solve(self, moments: Sequence[Moments]) -> Fit:
        return (self.solver or MODELS[self.name])(self.params, *moments)

    @property
    def second_pass(self) -> bool:
        return self.solver is None and self.name == "linear"


MODELS: dict[str, Callable[..., Fit]] = {
    "linear": lambda p, m: standardised_ridge(m, float(p.get("alpha", STANDARDISED_ALPHA))),
    "ridge": lambda p, m: raw_ridge(m, float(p.get("alpha", 1.0))),
    "weighted_linear": lambda p, m: weighted_ridge(m, 0.0),
    "weighted_ridge": lambda p, m: weighted_ridge(m, float(p.get("alpha", 1.0))),
    "max_sharpe": lambda p, m, y2: max_sharpe(m, y2, float(p.get("penalty", 0.0))),
}


def build_model(name: str, params: dict | None = None) -> Model:
    if name not in MODELS:
        raise ValueError(f"Unknown model {name!r}; known: {', '.join(sorted(MODELS))}.")
    return Model(name, dict(params or {}))
