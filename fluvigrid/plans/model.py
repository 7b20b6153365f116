"""Daily water balance of a vegetated soil column, after the published BROOK90 description.

One call simulates many parameter sets side by side: every state is an array over sets (and layers), so the cost of
a day is a few array operations however many sets a group has. Units: mm, days, degrees C, kPa, MJ/m2, m/s.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions import hydro as h
from .parameters import LandCover

# Model defaults besides those of the process functions.
FRINTL, FRINTS, FSINTL, FSINTS = 0.06, 0.06, 0.04, 0.04
CINTRL, CINTRS, CINTSL, CINTSS = 0.15, 0.15, 0.6, 0.6
GRDMLT, MAXLQF, SNODEN, CVLQ = 0.35, 0.05, 0.3, 0.00418
PSICR, RTRAD, DSWMAX, DPSIMX, GLMINC, Z0S = -2.0, 0.35, 2.0, 0.01, 0.03, 0.001
DURATION = (4, 4, 5, 3, 3, 2, 3, 3, 4, 4, 5, 5)
OUTPUTS = (
    "precc", "evpp", "floww", "rnett", "irvpp", "isvpp", "ptrann", "snoww", "swatt", "pintt", "snvpp", "slvpp", "trandd", "mesfld",
    "smltd", "slfld", "rfald", "awatt", "adeff", "sintdd", "rintdd", "sfald", "rthrd", "sthrd", "rsnod", "balerd",
)


@dataclass(frozen=True)
class Soil:
    """Layers from the top: thickness (mm), stone fraction, and Clapp-Hornberger parameters."""

    thick: np.ndarray
    stonef: np.ndarray
    psif: np.ndarray
    thetaf: np.ndarray
    thsat: np.ndarray
    bexp: np.ndarray
    kf: np.ndarray
    wetinf: np.ndarray


@dataclass
class Column:
    """One parameter set: site, cover and soil."""

    cover: LandCover
    soil: Soil
    latitude: float
    slope: float = 0.0
    aspect: float = 0.0
    idepth: float = 0.0
    infexp: float = 0.0
    dtimax: float = 0.5
    gsc: float = 0.0
    gsp: float = 0.0
    overrides: dict = field(default_factory=dict)


def split_single(soil: Soil) -> Soil:
    """A profile of one layer becomes two halves, as flow needs two."""
    if len(soil.thick) > 1:
        return soil
    parts = {k: np.repeat(getattr(soil, k), 2) for k in soil.__dataclass_fields__}
    parts["thick"] = parts["thick"] / 2
    return Soil(**parts)


def esat(t):
    es = np.where(t < 0, 0.61078 * np.exp(21.87456 * t / (t + 265.5)), 0.61078 * np.exp(17.26939 * t / (t + 237.3)))
    return es, np.where(t < 0, 5808 * es / (t + 265.5) ** 2, 4098 * es / (t + 237.3) ** 2)


def pm(aa, vpd, delta, ra, rc):
    return (ra * delta * aa + h.CPRHO * vpd) / ((delta + h.GAMMA) * ra + h.GAMMA * rc)


def half_day(lat, dec):
    lat = np.where(np.abs(lat) >= h.PI / 2, np.sign(lat) * (h.PI / 2 - 0.01), lat)
    a = -np.tan(dec) * np.tan(lat)
    return np.where(a >= 1, 0.0, np.where(a <= -1, h.PI, np.arccos(np.clip(a, -1, 1))))


def sun(lat, slope, aspect, doy):
    """Day length, horizontal insolation and slope factor."""
    scd = h.SOLAR / (1 - 0.0167 * np.cos(0.0172 * (doy - 3))) ** 2
    dec = np.arcsin(0.39785 * np.sin(4.868961 + 0.017203 * doy + 0.033446 * np.sin(6.224111 + 0.017202 * doy)))
    integral = lambda l2, l1, t3, t2: (np.sin(dec) * np.sin(l1) * (t3 - t2) + np.cos(dec) * np.cos(l1) * (np.sin(t3 + l2) - np.sin(t2 + l2))) / (2 * 3.14159)
    half = half_day(lat, dec)
    i0h = h.WTOMJ * scd * integral(0.0, lat, half, -half)
    l1 = np.arcsin(np.cos(slope) * np.sin(lat) + np.sin(slope) * np.cos(lat) * np.cos(aspect))
    d1 = np.cos(slope) * np.cos(lat) - np.sin(slope) * np.sin(lat) * np.cos(aspect)
    d1 = np.where(d1 == 0, 1e-10, d1)
    l2 = np.arctan(np.sin(slope) * np.sin(aspect) / d1) + np.where(d1 < 0, h.PI, 0.0)
    own = half_day(l1, dec)
    total = np.zeros_like(lat)
    for turn in (-2 * h.PI, 0.0, 2 * h.PI):  # a shifted slope day can meet the flat day twice
        t3, t2 = np.minimum(half, own - l2 + turn), np.maximum(-half, -own - l2 + turn)
        total += np.where(t3 > t2, h.WTOMJ * scd * integral(l2, l1, t3, t2) / np.cos(slope), 0.0)
    return np.clip(half / h.PI, 0.0001, 0.9999), i0h, np.where(i0h > 0, total / np.where(i0h > 0, i0h, 1), 0.0)


def at_day(doy, pairs):
    return np.interp(doy, pairs[::2], pairs[1::2])


class State:
    """Arrays over sets, and over sets x layers; absent layers of shorter profiles have thickness 0."""

    def __init__(self, columns: list[Column]):
        soils = [split_single(c.soil) for c in columns]
        self.n, self.layers = len(columns), max(len(s.thick) for s in soils)
        self.depth = np.array([len(s.thick) for s in soils])
        pad = lambda k, fill: np.array([np.concatenate([getattr(s, k), np.full(self.layers - len(s.thick), fill)]) for s in soils])
        self.thick, self.stonef = pad("thick", 0.0), pad("stonef", 0.0)
        self.psif, thetaf, self.thsat = pad("psif", -5.0), pad("thetaf", 0.3), pad("thsat", 0.45)
        self.bexp, self.kf, self.wetinf = pad("bexp", 5.0), pad("kf", 5.0), pad("wetinf", 0.92)
        self.there = np.arange(self.layers) < self.depth[:, None]
        middle = np.cumsum(self.thick, axis=1) - self.thick / 2
        self.psig = -h.RHOWG * middle
        self.swatmx = self.thick * self.thsat * (1 - self.stonef)
        self.wetf = thetaf / self.thsat
        psiinf = self.psif * (self.wetinf / self.wetf) ** -self.bexp
        self.chm = -psiinf / (1 - self.wetinf) ** 2 + self.bexp * psiinf / (self.wetinf * (1 - self.wetinf))
        self.chn = 2 * self.wetinf - 1 + psiinf * self.bexp / (self.chm * self.wetinf)
        self.ksat = self.kf * (1 / self.wetf) ** (2 * self.bexp + 3)
        self.swati = self.swatmx.copy()  # profiles start saturated
        self.snow, self.cc, self.snowlq, self.intr, self.ints, self.gwat = (np.zeros(self.n) for _ in range(6))
        # direct infiltration reaches down to idepth
        idepth, infexp = np.array([c.idepth for c in columns]), np.array([c.infexp for c in columns])
        bottom = np.cumsum(self.thick, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(infexp[:, None] > 0, np.minimum(1.0, bottom / np.maximum(idepth, 1e-9)[:, None]) ** np.maximum(infexp, 1e-9)[:, None], 1.0)
        self.infrac = np.diff(np.concatenate([np.zeros((self.n, 1)), share], axis=1), axis=1) * self.there
        roots = [np.interp(np.concatenate([[0.0], b]), np.arange(len(c.cover.rootden) + 1) * 100.0, np.concatenate([[0.0], np.cumsum(c.cover.rootden)])) for b, c in zip(bottom, columns, strict=True)]
        self.roots = np.diff(np.array(roots), axis=1) * (1 - self.stonef)
        self.roots /= np.maximum(self.roots.sum(axis=1, keepdims=True), 1e-12)

    def wetness(self):
        return np.where(self.there, self.swati / np.where(self.there, self.swatmx, 1), 0.5)

    def potential(self, w):
        base = np.maximum(w, 1e-6)
        return np.where(w <= 0, -1e10, np.where(w < self.wetinf, self.psif * (base / self.wetf) ** -self.bexp, np.where(w < 1, self.chm * (w - self.chn) * (w - 1), 0.0)))

    def slope(self, w):
        base = np.maximum(w, 1e-6)
        return np.where(w < self.wetinf, (-self.bexp * self.psif / self.wetf) * (base / self.wetf) ** (-self.bexp - 1), np.where(w < 1, self.chm * (2 * w - self.chn - 1), 0.0))

    def conductivity(self, w):
        return np.where(w > 1e-4, self.kf * (np.maximum(w, 1e-4) / self.wetf) ** (2 * self.bexp + 3), 1e-10)

    def storage(self):
        return self.swati.sum(axis=1) + self.snow + self.intr + self.ints + self.gwat


def limited_transpiration(ptr, psi, rplant, alpha, psicr):
    """Uptake per layer: Ohm's law between soil and leaf, no outflow from roots, limited by the critical potential."""
    use = np.isfinite(alpha) & (alpha > 0)
    out = np.zeros_like(psi)
    for _ in range(psi.shape[1] + 1):
        g = np.where(use, 1 / np.where(use, alpha, 1), 0.0)
        total = g.sum(axis=1)
        ok = total > 0
        rt = np.where(ok, 1 / np.where(ok, total, 1), 0.0)
        psit = rt * (psi * g).sum(axis=1)
        supply = np.where(ok, (psit - psicr) / (rplant + rt), 0.0)
        atr = np.where(ok, np.minimum(ptr, np.maximum(supply, 0)), 0.0)
        out = np.where(use, (psi - psit[:, None] + rt[:, None] * atr[:, None]) * g, 0.0)
        bad = use & (out < -1e-6)
        if not bad.any():
            break
        worst = np.where(bad, out, np.inf).argmin(axis=1)  # layers that would take up water leave one by one
        rows = np.flatnonzero(bad.any(axis=1))
        use[rows, worst[rows]] = False
    out = np.maximum(out, 0.0)
    return out.sum(axis=1), out


def day_of_catch(rate, potential, store, lai, sai, fl, fs, cl, cs, hours):
    """Hourly interception over a day: precipitation falls in ``hours`` around noon. Returns caught and evaporated, mm."""
    caught, lost = np.zeros_like(store), np.zeros_like(store)
    capacity = cl * lai + cs * sai
    half = max(1, int(hours / 2 + 0.1))
    for hour in range(24):
        falling = rate / (2 * half) if 12 - half <= hour < 12 + half else np.zeros_like(rate)
        most = (fl * lai + fs * sai) * falling
        new = store + most - potential / 24
        over = new > capacity
        catch = np.where(over & (new > 0), np.maximum(0.0, np.minimum(most, potential / 24 + capacity - store)), most)
        gone = np.where(store + catch - potential / 24 > 0, potential / 24, store + catch)
        store = store + catch - gone
        caught, lost = caught + catch, lost + gone
    return caught, lost, store


def snow_day(s: State, rthr, sthr, psnvp, snoen, ta):
    """One day of the snow pack: new snow and its cold, refreezing, evaporation and ground melt, energy, rain on snow.

    Returns rain kept, evaporation, melt water leaving, mm.
    """
    s.cc = s.cc + h.CVICE * np.maximum(-ta, 0) * sthr
    s.snow = s.snow + sthr
    frozen = np.minimum(s.snowlq, s.cc / h.LF)
    s.snowlq, s.cc = s.snowlq - frozen, s.cc - frozen * h.LF
    demand = np.maximum(psnvp, 0.0) + GRDMLT
    share = np.where(demand > 0, np.minimum(1.0, s.snow / demand), 0.0)
    evaporated = np.where(psnvp > 0, psnvp * share, np.where(s.snow > 0, psnvp, 0.0))
    melt = np.where(s.snow > 0, GRDMLT * share, 0.0)
    left = np.maximum(0.0, s.snow - np.maximum(evaporated, 0) - melt)
    keep = np.where(s.snow > 0, left / np.where(s.snow > 0, s.snow, 1), 0.0)
    s.cc, s.snowlq = s.cc * keep, s.snowlq * keep
    s.snow = left + np.maximum(-evaporated, 0)
    water = np.where(s.snow > 0, snoen / h.LF, 0.0)
    cold = np.maximum(-water, 0)
    frozen = np.minimum(cold, s.snowlq)
    s.snowlq = s.snowlq - frozen
    s.cc = np.minimum(s.cc + (cold - frozen) * h.LF, np.maximum(s.cc, h.CVICE * np.maximum(-ta, 0) * s.snow))
    warm = np.maximum(water, 0) + CVLQ * np.maximum(ta, 0) * rthr / h.LF * (s.snow > 0)
    used = np.minimum(warm, s.cc / h.LF)
    s.cc, warm = s.cc - used * h.LF, warm - used
    kept = np.where(s.snow > 0, rthr, 0.0)
    s.snow = s.snow + kept
    s.snowlq = np.minimum(s.snow, s.snowlq + kept + np.minimum(warm, s.snow))
    frozen = np.minimum(s.snowlq, s.cc / h.LF)
    s.snowlq, s.cc = s.snowlq - frozen, s.cc - frozen * h.LF
    gone = s.snowlq >= s.snow * (1 - 1e-9)
    out = np.where(gone, s.snow, np.maximum(0.0, (s.snowlq - MAXLQF * s.snow) / (1 - MAXLQF)))
    s.snow, s.snowlq = s.snow - out, np.where(gone, 0.0, s.snowlq - out)
    s.cc = np.where(s.snow > 0, s.cc, 0.0)
    return kept, evaporated, melt + out


def soil_day(s: State, water, uptake, evaporation, dtimax, gsc, gsp):
    """Move water through the profile for a day in adaptive steps; returns bypass, ground-water flow, seepage, mm."""
    bypass, flow, seep = np.zeros(s.n), np.zeros(s.n), np.zeros(s.n)
    left = np.ones(s.n)
    last = s.depth - 1
    row = np.arange(s.n)
    size = np.where(s.there, s.swatmx, 1.0)
    for _ in range(20_000):
        active = left > 1e-9
        if not active.any():
            break
        w = s.wetness()
        psi, k = s.potential(w), s.conductivity(w)
        total = psi + s.psig
        down = np.zeros_like(w)
        gap = total[:, :-1] - total[:, 1:]
        kk = np.minimum(np.sqrt(k[:, :-1] * k[:, 1:]), np.minimum(s.ksat[:, :-1], s.ksat[:, 1:]))
        thick = np.maximum(np.minimum(s.thick[:, :-1], s.thick[:, 1:]), 1e-9)
        inner = gap / thick * kk / h.RHOWG * (1 - (s.stonef[:, :-1] + s.stonef[:, 1:]) / 2)
        down[:, :-1] = np.where(s.there[:, 1:] & (np.abs(gap) >= DPSIMX), inner, 0.0)
        down[row, last] = k[row, last] * (1 - s.stonef[row, last])  # free drainage
        dt = np.minimum(left, dtimax)
        taken = uptake.copy()
        taken[:, 0] += evaporation
        source = water[:, None] * s.infrac

        def change():
            came = np.concatenate([np.zeros((s.n, 1)), down[:, :-1]], axis=1)
            return source + came - down - taken

        net = np.abs(change()) * s.there
        dt = np.minimum(dt, np.min(np.where(s.there, 0.01 * DSWMAX * size / np.maximum(net, 1e-6), np.inf), axis=1).clip(1e-4))
        # what would cross a layer's range in this step moves on instead: from the bottom up, water that does not fit
        # goes up, and out of the top as bypass; what is not there cannot leave
        for i in range(s.layers - 1, -1, -1):
            room = np.where(s.there[:, i], (s.swatmx[:, i] - s.swati[:, i]) / np.maximum(dt, 1e-9), 0.0)
            came = (down[:, i - 1] if i else 0.0) + source[:, i]
            over = np.where(s.there[:, i], came - down[:, i] - taken[:, i] - room, 0.0).clip(0)
            if i:
                down[:, i - 1] -= over
            else:
                source[:, 0] -= over
                spill = over
        for i in range(s.layers):
            have = s.swati[:, i] * 0.999 / np.maximum(dt, 1e-9) + source[:, i] + (down[:, i - 1] if i else 0.0)
            lack = np.where(s.there[:, i], down[:, i] + taken[:, i] - have, 0.0).clip(0)
            down[:, i] -= lack
        s.swati = np.where(active[:, None] & s.there, np.clip(s.swati + change() * dt[:, None], 1e-9, None), s.swati)
        dt = np.where(active, dt, 0.0)
        vrfl = down[row, last]
        gw = np.where(gsc < 1e-8, vrfl * (1 - gsp), np.minimum(s.gwat * gsc, s.gwat / np.maximum(dt, 1e-9)) * (1 - gsp))
        sp = np.where(gsc < 1e-8, vrfl * gsp, np.minimum(s.gwat * gsc, s.gwat / np.maximum(dt, 1e-9)) * gsp)
        s.gwat = s.gwat + (vrfl - gw - sp) * dt
        bypass, flow, seep = bypass + spill * dt, flow + gw * dt, seep + sp * dt
        left = left - dt
    else:
        raise RuntimeError("water did not settle within 20,000 steps of a day")
    return bypass, flow, seep


def simulate(columns: list[Column], weather: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Daily outputs, arrays sets x days. ``weather``: doy, month, solrad, tmax, tmin, ea, uw, prec[, mesfl].

    ``balerd`` is the day's water-balance residual. ``awatt`` and ``adeff`` are kept for compatibility and are 0.
    """
    s = State(columns)
    days = len(weather["doy"])
    out = {k: np.zeros((s.n, days)) for k in OUTPUTS}
    get = lambda k: np.array([getattr(c.cover, k) for c in columns])
    alb, albsn, ksnvp, z0g, maxht, maxlai, mxrtln, mxkpl, fxylem, lwidth, cr = (get(k) for k in ("alb", "albsn", "ksnvp", "z0g", "maxht", "maxlai", "mxrtln", "mxkpl", "fxylem", "lwidth", "cr"))
    glmax, glmin = get("glmax") / 100, GLMINC / 100
    lat, slope, aspect = (np.array([getattr(c, k) for c in columns]) for k in ("latitude", "slope", "aspect"))
    dtimax, gsc, gsp = (np.array([getattr(c, k) for c in columns]) for k in ("dtimax", "gsc", "gsp"))
    for d in range(days):
        doy, tmax, tmin, prec = (float(weather[k][d]) for k in ("doy", "tmax", "tmin", "prec"))
        before = s.storage()
        daylen, i0h, slf = sun(lat, slope, aspect, doy)
        relht = np.array([at_day(doy, c.cover.relht) for c in columns])
        rellai = np.array([at_day(doy, c.cover.rellai) for c in columns])
        base = np.maximum(0.01, relht * maxht)
        height = np.maximum(0.01, base - 0.001 * s.snow / SNODEN)
        cut = np.maximum(0.0, base - 0.001 * s.snow / SNODEN) / base
        lai, sai = np.maximum(1e-5, cut * rellai * maxlai), h.CS * height
        rtlen, rplant = relht * mxrtln, 1 / np.maximum(1e-8, relht * mxkpl)
        ground = np.where(s.snow > 0, Z0S, z0g)
        z0c = np.where(height >= h.HR, h.CZR * height, np.where(height <= h.HS, h.CZS * height, h.CZS * h.HS + (h.CZR * h.HR - h.CZS * h.HS) * (height - h.HS) / (h.HR - h.HS)))
        dispc, z0gs = height - z0c / 0.3, np.minimum(ground, z0c)
        ratio = (lai + sai) / (h.LPC + h.CS * height)
        xx = ratio * (-1 + np.exp(0.909 - 3.03 * z0c / height)) ** 4
        disp = np.where(ratio >= 1, dispc, 1.1 * height * np.log(1 + xx**0.25))
        z0 = np.where(ratio >= 1, z0c, np.minimum(0.3 * (height - disp), z0gs + 0.3 * height * np.sqrt(xx)))
        za = height + h.ZMINH
        hibl = 0.334 * h.FETCH**0.875 * h.Z0W**0.125
        adjust = np.log(hibl / h.Z0W) * np.log((za - disp) / z0) / (np.log(hibl / z0) * np.log(h.ZW / h.Z0W))
        solrad = float(weather["solrad"][d])
        solradc = np.where(solrad < 0.001, h.RRD * i0h, np.where(solrad > i0h, 0.99 * i0h, solrad))
        ta = (tmax + tmin) / 2
        wave = np.sin(h.PI * daylen)
        t_day, t_night = ta + (tmax - tmin) / (2 * h.PI * daylen) * wave, ta - (tmax - tmin) / (2 * h.PI * (1 - daylen)) * wave
        ea = float(weather["ea"][d]) or float(esat(np.array(tmin))[0])
        uw = float(weather["uw"][d]) or 0.1
        ua = max(0.2, uw) * adjust
        u_day = ua / (daylen + (1 - daylen) * h.WNDRAT)
        snowing = 0.0 if tmin >= h.RSTEMP else 1.0 if tmax < h.RSTEMP else 1 - (tmax - h.RSTEMP) / (tmax - tmin)
        sfal, rfal = np.full(s.n, prec * snowing), np.full(s.n, prec * (1 - snowing))
        covered = s.snow > 0
        tsnow = np.where(covered, -s.cc / (h.CVICE * np.maximum(s.snow, 1e-9)), 0.0)
        w = s.wetness()
        psi = s.potential(w)
        rss = np.where(covered, 0.0, h.RSSA * (psi[:, 0] / s.psif[:, 0]) ** h.RSSB)
        rss = np.maximum(rss, 0.0)
        albedo = np.where(covered, albsn, alb)
        snoen = np.where(ta <= 0, h.CCFAC * 2 * daylen * (ta - tsnow), h.MELFAC * 2 * daylen * slf * ta * np.exp(-h.SAIMLT * sai - h.LAIMLT * lai))
        # resistances from the soil to the leaf
        density = s.roots * rtlen[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            delt = np.clip(np.pi * RTRAD**2 * density / np.maximum(s.thick, 1e-9) / 1000, 1e-9, 0.9)
            soil_part = (delt - 3 - 2 * np.log(delt) / (1 - delt)) / (8 * np.pi * np.maximum(density, 1e-9) * np.maximum(s.conductivity(w), 1e-10))
            rooti = (rplant * (1 - fxylem))[:, None] / np.maximum(s.roots, 1e-12)
            alpha = np.where((s.roots > 1e-6) & s.there, rooti + h.RHOWG * soil_part, np.inf)
        rxylem = fxylem * rplant
        ptran, gevp, pint, give, trani = np.zeros(s.n), np.zeros(s.n), np.zeros(s.n), np.zeros(s.n), np.zeros_like(w)
        psnvp = np.zeros(s.n)
        for share, temp, wind, light in ((daylen, t_day, u_day, True), (1 - daylen, t_night, h.WNDRAT * u_day, False)):
            slrad = slf * solradc / (h.WTOMJ * daylen) if light else np.zeros(s.n)
            effem = 1.24 * (ea * 10 / (temp + 273.15)) ** (1 / 7)
            cloud = h.C3 + (1 - h.C3) * np.clip((solradc / np.maximum(i0h, 1e-9) - h.C1) / h.C2, 0, 1)
            rn = (1 - albedo) * slrad + (effem - 1) * cloud * h.SIGMA * (temp + 273.15) ** 4
            aa, asubs = rn, rn * np.exp(-cr * (lai + sai))
            es, delta = esat(temp)
            vpd = np.maximum(0.0, es - ea)
            ustar = h.KARMAN * wind / np.log((za - disp) / z0)
            kh = h.KARMAN * ustar * (height - disp)
            ras = np.maximum(1.0, height * np.exp(h.NN) / (h.NN * kh) * (np.exp(-h.NN * z0gs / height) - np.exp(-h.NN * (z0c + dispc) / height)))
            raa = np.maximum(1e-3, np.log((za - disp) / (height - disp)) / (h.KARMAN * ustar) + height / (h.NN * kh) * (-1 + np.exp(h.NN * (height - dispc - z0c) / height)))
            uh = np.maximum(1e-6, ustar / h.KARMAN * np.log((height - disp) / z0))
            rac = 100 * h.NN * np.sqrt(lwidth / uh) / (1 - np.exp(-h.NN / 2)) / (h.RHOTP * lai + h.PI * sai)
            if light:
                fs = (2 * lai + sai) / (2 * lai)
                r0 = h.RM * h.R5 / (h.RM - 2 * h.R5)
                par = np.where(slrad <= 1e-10, 0.0, (h.RM + r0) / (h.RM * cr * fs) * np.log((r0 + cr * slrad) / (r0 + cr * slrad * np.exp(-cr * fs * lai))))
                warm = np.where(temp <= h.TL, 0.0, np.where(temp < h.T1, 1 - ((h.T1 - temp) / (h.T1 - h.TL)) ** 2, np.where(temp <= h.T2, 1.0, 0.0)))
                rsc = 1 / np.maximum(1e-12, par * warm / (1 + vpd / h.CVPD) * (glmax - glmin) + lai * glmin)
            else:
                rsc = 1 / np.maximum(1e-12, lai * glmin)

            def rates(rc_leaf, aa=aa, asubs=asubs, vpd=vpd, delta=delta, raa=raa, rac=rac, ras=ras):
                rs, rc, ra = (delta + h.GAMMA) * ras + h.GAMMA * rss, (delta + h.GAMMA) * rac + h.GAMMA * rc_leaf, (delta + h.GAMMA) * raa
                ccs, ccc = 1 / (1 + rs * ra / (rc * (rs + ra))), 1 / (1 + rc * ra / (rs * (rc + ra)))
                pms = pm(aa, vpd - delta * ras * (aa - asubs) / h.CPRHO, delta, raa + ras, rss)
                pmc = pm(aa, vpd - delta * rac * asubs / h.CPRHO, delta, raa + rac, rc_leaf)
                le = ccc * pmc + ccs * pms
                d0 = vpd + raa * (delta * aa - (delta + h.GAMMA) * le) / h.CPRHO
                unit = h.ETOM * h.WTOMJ
                return unit * pm(aa - asubs, d0, delta, rac, rc_leaf), unit * pm(asubs, d0, delta, ras, rss)

            ptr, ger = rates(rsc)
            pir, gir = rates(np.zeros(s.n))
            ptr, pir = np.maximum(ptr, 0.0), np.maximum(pir, 0.0)
            atr, tri = limited_transpiration(ptr, psi * 1e-3, rxylem, alpha, np.full(s.n, PSICR))
            atr, tri = np.where(ptr > 0.001, atr, 0.0), np.where((ptr > 0.001)[:, None], tri, 0.0)
            rs, ra = (delta + h.GAMMA) * ras + h.GAMMA * rss, (delta + h.GAMMA) * raa
            le = rs / (rs + ra) * (atr / (h.ETOM * h.WTOMJ)) + (h.CPRHO * vpd + delta * ras * asubs + delta * raa * aa) / (rs + ra)
            ger = np.where(atr < ptr, h.ETOM * h.WTOMJ * (le - atr / (h.ETOM * h.WTOMJ)), ger)
            ptran, gevp, pint, give, trani = ptran + share * ptr, gevp + share * ger, pint + share * pir, give + share * gir, trani + share[:, None] * tri
            at = np.where(tsnow > -0.1, 0.61, esat(np.minimum(temp, tsnow))[0])
            psnvp = psnvp + share * ksnvp * (h.WTOMJ / h.LS) * (h.CPRHO / h.GAMMA) * (at - ea) / (raa + ras)
        hours = DURATION[int(weather["month"][d]) - 1]
        some = np.maximum(pint, 1e-9)
        sint, isvp, s.ints = day_of_catch(sfal, pint, s.ints, lai, sai, FSINTL, FSINTS, CINTSL, CINTSS, hours)
        rint, irvp, s.intr = day_of_catch(rfal, np.maximum(0.0, pint - isvp), s.intr, lai, sai, FRINTL, FRINTS, CINTRL, CINTRS, hours)
        dry = 1 - np.clip((irvp + isvp) / some, 0, 1)
        trani = trani * dry[:, None]
        rthr, sthr = rfal - rint, sfal - sint
        had = (s.snow > 0) | (sthr > 0)
        kept, snvp, smlt = snow_day(s, np.where(had, rthr, 0.0), sthr, np.where(had, psnvp, 0.0), np.where(had, snoen, 0.0), ta)
        rnet = rthr - kept
        slvp = np.where(had, 0.0, np.maximum(0.0, gevp * dry + give * (1 - dry)))
        slvp = np.minimum(slvp, np.maximum(0.0, s.swati[:, 0] - 0.05 * s.swatmx[:, 0]))
        trani = np.minimum(trani, np.maximum(0.0, 0.9 * s.swati - 0.02 * s.swatmx) * s.there)
        bypass, gwfl, seep = soil_day(s, rnet + smlt, trani, slvp, dtimax, gsc, gsp)
        tran = trani.sum(axis=1)
        evap, flow_out = irvp + isvp + snvp + slvp + tran, bypass + gwfl
        now = {
            "precc": prec, "evpp": evap, "floww": flow_out, "rnett": rnet, "irvpp": irvp, "isvpp": isvp, "ptrann": ptran, "snoww": s.snow, "swatt": s.swati.sum(axis=1), "pintt": pint,
            "snvpp": snvp, "slvpp": slvp, "trandd": tran, "mesfld": weather["mesfl"][d] if "mesfl" in weather else 0.0, "smltd": smlt, "slfld": rnet + smlt - bypass, "rfald": rfal,
            "sintdd": sint, "rintdd": rint, "sfald": sfal, "rthrd": rthr, "sthrd": sthr, "rsnod": kept, "balerd": before - s.storage() + prec - evap - flow_out - seep,
        }
        for k, v in now.items():
            out[k][:, d] = v
    return out
