import pytest

from sonoframe import config
from sonoframe.config import Device, Precondition, VersionRange


def test_devices():
    assert config.select_device({Device.CUDA}) == (Device.CUDA, "float16")
    assert config.select_device(set()) == (Device.CPU, "float32")
    assert config.select_device({Device.MPS}, compatible=(Device.CPU,))[0] is Device.CPU
    with pytest.raises(ValueError):
        config.select_device(set(), Device.CUDA)


def test_versions():
    assert "3.13.1" in VersionRange(">=3.12,<4") and "3.11" not in VersionRange(">=3.12") and "2.0" in VersionRange("")
    assert "1.10" in VersionRange(">1.9") and "1.0" in VersionRange("==1.0.0")


def test_preconditions():
    table = {"old": Precondition(VersionRange("<3")), "none": Precondition(packages={"no-such-package": VersionRange()}), "own": Precondition(VersionRange("<3"), isolated=True)}
    assert config.check_precondition("unknown", table) and config.check_precondition("own", table) and config.check_precondition("kernels")
    for name in ("old", "none"):
        with pytest.raises(RuntimeError):
            config.requires(name, table)(lambda: 1)()


def test_names():
    def loud_metric():
        pass

    assert config.evaluation_name(loud_metric) == "loud_metric"
    with pytest.raises(ValueError):
        config.evaluation_name(test_names)
