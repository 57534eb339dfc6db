"""Parameters of the lease-contract engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# Source columns, labels, periods and thresholds that results depend on.
COLUMN_MAP = {
    "NO": "row_no", "시군구": "sigungu", "번지": "jibun", "본번": "bonbun", "부번": "bubun", "건물명": "building_name",
    "전월세구분": "rent_type", "전용면적(㎡)": "area_m2", "계약년월": "contract_ym", "계약일": "contract_day",
    "보증금(만원)": "deposit_10k", "월세금(만원)": "monthly_rent_10k", "층": "floor", "건축년도": "built_year",
    "도로명": "road_name", "계약기간": "contract_period", "계약구분": "contract_type", "갱신요구권 사용": "renewal_request_used",
    "종전계약 보증금(만원)": "previous_deposit_10k", "종전계약 월세(만원)": "previous_monthly_rent_10k", "주택유형": "housing_type",
}
COLUMN_ALIASES = {"단지명": "건물명"}
ENCODINGS = ("cp949", "euc-kr", "utf-8-sig", "utf-8")
NUMERIC_COLUMNS = ("area_m2", "deposit_10k", "monthly_rent_10k", "floor", "built_year", "previous_deposit_10k", "previous_monthly_rent_10k")
MISSING_TOKENS = ("", "-", "nan", "NaN", "None", "none", "null")
META_COLUMNS = ("source_file", "source_sheet", "source_table_id", "source_cond_gu", "source_cond_period", "housing_category")
JEONSE, MONTHLY = "전세", "월세"
ROW_HOUSE, OFFICETEL = "연립다세대", "오피스텔"
SPLITS = {"train": ("2021-01-01", "2024-12-31"), "validation": ("2025-01-01", "2025-12-31"), "test": ("2026-01-01", "2026-09-15")}
MODEL_SPLITS = {"train": ("2021-01-01", "2024-12-31"), "valid": ("2025-01-01", "2025-06-30"), "calib": ("2025-07-01", "2025-12-31"), "test": ("2026-01-01", "2026-09-15")}
AREA_BINS = ((0, 15), (15, 20), (20, 25), (25, 30), (30, 40), (40, 60), (60, 85), (85, None))
PYEONG_M2 = 3.305785
ROOM_TYPES = {"원룸": (0, 25), "투룸": (25, 45), "쓰리룸+": (45, 200), "전체": (0, 1000)}
Z90 = 1.2815515655446004


@dataclass(frozen=True)
class EngineConfig:
    """One frozen set of parameters for all stages."""

    valid_gu: tuple[str, ...] = ("동작구", "노원구", "서대문구", "동대문구", "성북구")
    drop_invalid_gu: bool = False
    start_date: str = "2021-01-01"
    end_date: str = "2026-09-15"
    partial_year: int = 2026
    housing_categories: tuple[str, ...] = (ROW_HOUSE, OFFICETEL)
    rolling_windows: tuple[int, ...] = (30, 90, 180)
    property_days: int = 365
    trend_days: int = 90
    min_count: int = 3
    dong_keys: tuple[str, ...] = ("gu", "dong", "rent_type", "housing_category")
    gu_keys: tuple[str, ...] = ("gu", "rent_type", "housing_category")
    comp_keys: tuple[str, ...] = ("gu", "dong", "rent_type", "housing_category", "area_bin")
    coverage_keys: tuple[str, ...] = ("gu", "housing_category")
    property_keys: tuple[str, ...] = ("property_id", "rent_type")
    outlier_keys: tuple[str, ...] = ("gu", "rent_type", "housing_category", "area_bin")
    outlier_k: float = 3.0
    outlier_min_group: int = 30
    new_only: bool = True
    include_unknown: bool = False
    model_start: str | None = None
    exclude_gu: tuple[str, ...] = ()
    min_jeonse_share: float = 0.05
    max_deposit_ratio: float = 0.25
    horizons: tuple[int, ...] = (0, 30, 60, 90, 120, 150, 180)
    reporting_lag: int = 30
    quantiles: tuple[float, float, float] = (0.1, 0.5, 0.9)
    target_coverage: float = 0.8
    radii_m: tuple[int, ...] = (1000, 1500, 2000)
    min_buildings: int = 30
    lookback_days: int = 365
    weight_days: int = 730
    splits: dict = field(default_factory=lambda: dict(SPLITS))
    model_splits: dict = field(default_factory=lambda: dict(MODEL_SPLITS))


DEFAULT = EngineConfig()
