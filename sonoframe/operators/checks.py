"""Threshold checks on metrics, as data: which metric, and what it is held against.

A check of a null metric is null. NaN fails every comparison (in Spark NaN is larger than any number, so each check
guards it), but for the voice ratio, whose check of NaN is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """metric ``op`` bound; with ``upper`` also metric < upper. ``magnitude`` compares the absolute value."""

    metric: str
    op: str
    bound: float
    upper: float | None = None
    magnitude: bool = False
    nan_is_null: bool = False


#: Comparators and default thresholds of each check.
CHECKS = {
    "audio_intensity_zero_check": Check("dynamic_range_metric", "=", 0),
    "audio_intensity_positive_check": Check("dynamic_range_metric", ">", 0),
    "very_high_headroom_check": Check("amplitude_headroom_metric", ">", 0.95),
    "very_high_amplitude_interquartile_range_check": Check("amplitude_interquartile_range_metric", ">", 1.5),
    "very_low_amplitude_kurtosis_check": Check("amplitude_kurtosis_metric", "<", -100),
    "very_high_amplitude_kurtosis_check": Check("amplitude_kurtosis_metric", ">", 100),
    "very_low_amplitude_modulation_depth_check": Check("amplitude_modulation_depth_metric", "<", 0.1),
    "low_amplitude_modulation_depth_check": Check("amplitude_modulation_depth_metric", ">=", 0.1, 0.3),
    "high_proportion_clipped_check": Check("proportion_clipped_metric", ">", 0.0001),
    "clipping_present_check": Check("proportion_clipped_metric", ">", 0),
    "completely_silent_check": Check("proportion_silent_metric", ">=", 1.0),
    "mostly_silent_check": Check("proportion_silent_metric", ">", 0.99),
    "high_amplitude_skew_magnitude_check": Check("amplitude_skew_metric", ">", 5.0, magnitude=True),
    "high_crest_factor_check": Check("crest_factor_metric", ">=", 20.0),
    "low_crest_factor_check": Check("crest_factor_metric", "<=", 1.5),
    "very_low_dynamic_range_check": Check("dynamic_range_metric", "<", 0.1),
    "very_low_mean_absolute_deviation_check": Check("mean_absolute_deviation_metric", "<", 0.001),
    "very_high_mean_absolute_deviation_check": Check("mean_absolute_deviation_metric", ">", 0.5),
    "very_low_peak_snr_from_spectral_check": Check("peak_snr_from_spectral_metric", "<", 10),
    "low_peak_snr_from_spectral_check": Check("peak_snr_from_spectral_metric", ">=", 10, 20),
    "very_high_peak_snr_from_spectral_check": Check("peak_snr_from_spectral_metric", ">", 60),
    "low_phase_correlation_check": Check("phase_correlation_metric", "<", 0.99),
    "high_proportion_silence_at_beginning_check": Check("proportion_silence_at_beginning_metric", ">", 0.2),
    "high_proportion_silence_at_end_check": Check("proportion_silence_at_end_metric", ">", 0.2),
    "very_low_root_mean_square_energy_check": Check("root_mean_square_energy_metric", "<", 0.005),
    "very_high_root_mean_square_energy_check": Check("root_mean_square_energy_metric", ">", 0.5),
    "low_shannon_entropy_amplitude_check": Check("shannon_entropy_amplitude_metric", "<", 2.0),
    "high_shannon_entropy_amplitude_check": Check("shannon_entropy_amplitude_metric", ">", 7.5),
    "low_signal_variance_check": Check("signal_variance_metric", "<", 1e-4),
    "high_signal_variance_check": Check("signal_variance_metric", ">", 0.3),
    "low_spectral_gating_snr_check": Check("spectral_gating_snr_metric", "<", 10),
    "high_spectral_gating_snr_check": Check("spectral_gating_snr_metric", ">", 60),
    "low_zero_crossing_rate_check": Check("zero_crossing_rate_metric", "<", 0.01),
    "high_zero_crossing_rate_check": Check("zero_crossing_rate_metric", ">=", 0.15, 0.3),
    "very_high_zero_crossing_rate_check": Check("zero_crossing_rate_metric", ">", 0.3),
    "primary_speaker_ratio_check": Check("primary_speaker_ratio_metric", ">", 0.8),
    "voice_activity_detection_check": Check("voice_activity_detection_metric", ">", 0),
    "voice_signal_to_noise_power_ratio_check": Check("voice_signal_to_noise_power_ratio_metric", ">", -1, nan_is_null=True),
}

#: The check that looks at the signal itself.
LENGTH_CHECK = "audio_length_zero_check"

_COMPARE = {
    "=": lambda m, t: m == t,
    ">": lambda m, t: m > t,
    ">=": lambda m, t: m >= t,
    "<": lambda m, t: m < t,
    "<=": lambda m, t: m <= t,
}


def check_column(name: str, metric: Column, bound: float | None = None, upper: float | None = None) -> Column:
    """The boolean column of a check, with its own thresholds unless others are given."""
    c = CHECKS[name]
    value = F.abs(metric) if c.magnitude else metric
    result = _COMPARE[c.op](value, F.lit(float(c.bound if bound is None else bound)))
    top = c.upper if upper is None else upper
    if top is not None:
        result = result & (value < F.lit(float(top)))
    return F.when(F.isnan(metric), F.lit(None) if c.nan_is_null else F.lit(False)).otherwise(result).alias(name)


def length_zero_check(channels: Column) -> Column:
    return (F.size(F.flatten(channels)) == 0).alias(LENGTH_CHECK)
