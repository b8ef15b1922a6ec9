"""Options of an association scan, validated."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names of the methods and of the ways to fit a null model.
METHODS = ("BURDEN", "CALPHA", "CMC", "CMC1df", "VT", "WSS", "RVT1", "RVT2", "SKAT", "SKATO", "VAAST", "SKATC")
OPTIMIZERS = ("irls", "irls_svdnewton", "irls_qr", "irls_qr_R", "gradient_descent")
QUANTITATIVE = frozenset({"BURDEN", "RVT1", "RVT2", "SKAT", "SKATO", "SKATC", "VT"})
#: Methods that report a p-value even when permuting: a hit is a permuted value that is as small.
ALWAYS_P = frozenset({"RVT1", "RVT2", "SKATO", "SKATC"})


@dataclass(frozen=True)
class AssocConfig:
    method: str = "VAAST"
    nperm: int = 10_000
    max_perms: int | None = None
    successes: int = 200
    pthresh: float | None = None
    mac: float = float("inf")
    maf: float = 0.5
    ma_count: bool = False
    min_minor_allele_count: int = 1
    min_variant_count: int = 1
    max_levels: int = 100
    bin_epsilon: float = 1e-4
    seed: int = 1
    optimizer: str = "irls"  # of the null model
    whole_gene: bool = False
    impute: str | None = None
    var_collapsing: int | None = None
    group_size: int = 4
    grouping: str = "pooled"
    soft_maf_filter: float = 1.0
    biallelic: bool = False
    site_penalty: float = 2.0
    kernel: str = "wLinear"
    qtl: bool = False
    beta_weights: tuple[float, float] = (1.0, 25.0)
    no_weights: bool = False
    file_weights: bool = False  # variants bring their weights from a file, and keep them
    saddlepoint: bool = False
    cmcmaf: float = 0.005
    hotellings: bool = False
    covariates: tuple[str, ...] = field(default=())
    testable: float | None = None  # leave out groups whose most extreme labels would not reach this level
    output_stats: bool = False  # list every permuted statistic

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; known: {', '.join(METHODS)}")
        if self.qtl and self.method not in QUANTITATIVE:
            raise ValueError(f"{self.method} takes no quantitative trait")
        if self.optimizer not in OPTIMIZERS:
            raise ValueError(f"unknown optimizer {self.optimizer!r}; known: {', '.join(OPTIMIZERS)}")
        if self.grouping not in ("pooled", "by_type"):
            raise ValueError("grouping is 'pooled' or 'by_type'")
        if self.impute not in (None, "af", "dosage"):
            raise ValueError("impute is None, 'af' or 'dosage'")

    @property
    def analytic(self) -> bool:
        """Whether a smaller value is more extreme."""
        return self.method in ALWAYS_P or (self.nperm == 0 and self.method in ("SKAT", "CMC", "CMC1df", "BURDEN"))

    @property
    def block(self) -> int:
        """Permutations in a block: never more than are wanted at all."""
        return min(self.nperm, self.max_perms) if self.max_perms else self.nperm
