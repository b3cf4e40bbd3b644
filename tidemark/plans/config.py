"""Layered configuration: merging, overrides by environment, paths, and the parameter sampler."""

from __future__ import annotations

import ast
import operator
import random
from typing import Any


def deep_merge(a: dict, b: dict) -> dict:
    """b over a; dictionaries are merged, everything else replaced."""
    return {k: deep_merge(a[k], b[k]) if isinstance(a.get(k), dict) and isinstance(b.get(k), dict) else b.get(k, a.get(k)) for k in {**a, **b}}


def layered(main: dict, bases: list[dict] = (), overlays: list[dict] = (), extends: dict | None = None) -> dict:
    """extends < bases < main < overlays."""
    out: dict = {}
    for layer in (extends or {}, *bases, main, *overlays):
        out = deep_merge(out, layer)
    return out


def deep_get(cfg: dict, path: str, default: Any = None) -> Any:
    for key in path.split("."):
        if not isinstance(cfg, dict) or key not in cfg:
            return default
        cfg = cfg[key]
    return cfg


def deep_set(cfg: dict, path: str, value: Any) -> dict:
    head, _, rest = path.partition(".")
    inner = cfg.get(head) if isinstance(cfg.get(head), dict) else {}
    return {**cfg, head: deep_set(inner, rest, value) if rest else value}


def env_overrides(cfg: dict, env: dict[str, str], prefix: str = "BOT") -> dict:
    """Values of PREFIX_A_B_C, else A_B_C, for every path a.b.c that the configuration has."""
    out = cfg
    for path in paths(cfg):
        name = path.upper().replace(".", "_")
        raw = env.get(f"{prefix}_{name}", env.get(name))
        if raw is not None:
            try:
                value = ast.literal_eval(raw)
            except (ValueError, SyntaxError):
                value = {"true": True, "false": False}.get(raw.lower(), raw)
            out = deep_set(out, path, value)
    return out


def paths(cfg: dict, at: str = "") -> list[str]:
    return [p for k, v in cfg.items() for p in (paths(v, f"{at}{k}.") if isinstance(v, dict) and v else [f"{at}{k}"])]


def validate(cfg: dict, required: dict[str, type], strict: bool = True) -> list[str]:
    """Names of missing or mistyped settings; strict raises instead."""
    bad = [p for p, t in required.items() if not isinstance(deep_get(cfg, p), t)]
    if bad and strict:
        raise ValueError(f"missing or mistyped: {', '.join(bad)}")
    return bad


OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.Pow: operator.pow}


def formula(text: str, values: dict[str, float]) -> float:
    """Arithmetic over names, numbers, min, max and round; nothing else is evaluated."""

    def walk(n: ast.AST) -> float:
        if isinstance(n, ast.Expression):
            return walk(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return n.value
        if isinstance(n, ast.Name):
            return values[n.id]
        if isinstance(n, ast.BinOp) and type(n.op) in OPS:
            return OPS[type(n.op)](walk(n.left), walk(n.right))
        if isinstance(n, ast.UnaryOp) and type(n.op) in OPS:
            return OPS[type(n.op)](walk(n.operand))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in ("min", "max", "round"):
            return {"min": min, "max": max, "round": round}[n.func.id](*map(walk, n.args))
        raise ValueError(f"not allowed in a formula: {text}")

    return walk(ast.parse(text, mode="eval"))


def sample(space: dict[str, dict], seed: int, rules: dict[str, str] | None = None) -> dict:
    """One draw from a space of int, float, choice and float_vec parameters, then dependent formulas."""
    rng = random.Random(seed)
    out: dict[str, Any] = {}
    for name, s in space.items():
        kind = s["type"]
        if kind == "int":
            out[name] = rng.randrange(s["low"], s["high"] + 1, s.get("step", 1))
        elif kind == "float":
            out[name] = rng.uniform(s["low"], s["high"])
        elif kind == "choice":
            out[name] = rng.choice(s["values"])
        elif kind == "float_vec":
            out[name] = [rng.uniform(s["low"], s["high"]) for _ in range(s["size"])]
        else:
            raise ValueError(f"no parameter type: {kind}")
    for name, text in (rules or {}).items():
        out[name] = formula(text, out)
    return out
