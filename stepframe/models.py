"""Small example components: stored starch and taken-up nitrate of organs, and a pool of water that they draw on."""

from __future__ import annotations

from dataclasses import dataclass

from stepframe.operators.component import Component
from stepframe.plans.catalog import declare
from stepframe.plans.schedule import axial, rate, state, totalstate


def _variable(kind: str, state_kind: str = "", by: str = "", default: float = 0.0, unit: str = "-", about: str = ""):
    return declare(unit, "", about, "", "", "", "", "", kind, by, state_kind, "user", default=default)


@dataclass(init=False)
class Starch(Component):
    nitrate: float = _variable("input", by="mineral", unit="mol/g")
    light: float = _variable("input", by="weather", default=4.0, unit="W/m2")
    starch: float = _variable("state_variable", "massic_concentration", default=2.0, unit="mol/g", about="starch that is stored")
    gain: float = _variable("state_variable", "NonInertialExtensive", unit="mol/s")
    vigour: float = _variable("state_variable", "intensive", default=1.0)
    shade: float = _variable("state_variable", "NonInertialIntensive")
    surface: float = _variable("state_variable", "extensive", default=0.5, unit="m2")
    rank: float = _variable("state_variable", "descriptor")
    efficiency: float = _variable("parameter", default=0.25)
    reserve: float = _variable("plant_scale_state", unit="mol")

    @rate
    def _gain(self, light, nitrate, shade):
        return self.efficiency * light * (1.0 - shade) + 0.5 * nitrate

    @state
    def _starch(self, starch, gain, struct_mass):
        return starch + self.time_step * gain / (struct_mass + 1000.0)

    @axial
    def _shade(self, surface):
        return 0.125 if surface > 1.0 else 0.0

    @totalstate
    def _reserve(self, starch):
        return sum(starch.values())


@dataclass(init=False)
class Mineral(Component):
    starch: float = _variable("input", by="starch", unit="mol/g")
    water: float = _variable("input", by="pool", unit="g")
    nitrate: float = _variable("state_variable", "massic_concentration", default=1.0, unit="mol/g")
    uptake: float = _variable("state_variable", "NonInertialExtensive", unit="mol/s")

    @rate
    def _uptake(self, nitrate):
        return max(3.0 - nitrate, 0.0)

    @state
    def _nitrate(self, nitrate, uptake):
        return nitrate + 0.25 * uptake


@dataclass(init=False)
class Pool(Component):
    uptake: float = _variable("input", by="mineral", unit="mol/s")
    water: float = _variable("state_variable", "extensive", by="pool", default=64.0, unit="g")

    @state
    def _water(self, water, uptake):
        return water - 0.5 * uptake


COMPONENTS = {"Starch": Starch, "Mineral": Mineral, "SoilModel": Pool}
TRANSLATOR = {
    "Starch": {"Mineral": {"nitrate": {"nitrate": 1.0}}, "SoilModel": {}},
    "Mineral": {"Starch": {"starch": {"starch": 1.0}}, "SoilModel": {"water": {"water": 1.0}}},
    "SoilModel": {"Mineral": {"uptake": {"uptake": 1.0}}},
}
