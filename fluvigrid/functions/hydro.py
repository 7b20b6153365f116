"""Process functions of the BROOK90 water-balance model as column expressions.

Names and units follow the published model description: mm, days, degrees C, kPa, MPa, W/m2 unless stated. Every
function is closed-form, so it stays in generated code and has a plain SQL counterpart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants of the model description.
WTOMJ, ETOM, CPRHO, GAMMA = 0.0864, 0.4085, 1240.0, 0.067
CVICE, LF, LS, RHOWG = 0.00192, 0.335, 2.824, 0.00981
SIGMA, SOLAR, KARMAN, PI = 5.67e-8, 1367.0, 0.4, 3.1416
# Defaults of the model's parameters.
C1, C2, C3 = 0.25, 0.5, 0.2
CCFAC, MELFAC, LAIMLT, SAIMLT, RSTEMP = 0.3, 1.5, 0.2, 0.5, -0.5
CS, CVPD, CZR, CZS, HR, HS, LPC = 0.035, 2.0, 0.05, 0.13, 10.0, 1.0, 4.0
FETCH, Z0W, ZW, ZMINH, WNDRAT = 5000.0, 0.005, 10.0, 2.0, 0.3
R5, RM, RRD, NN, RHOTP = 100.0, 1000.0, 0.55, 2.5, 2.0
TL, T1, T2, TH = 0.0, 10.0, 30.0, 0.0
RSSA, RSSB = 500.0, 1.0


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), v))


def safe_acos(v: Column) -> Column:
    return F.acos(clamp(v, -1.0, 1.0))


def safe_asin(v: Column) -> Column:
    return F.asin(clamp(v, -1.0, 1.0))


def esat(t: Column) -> tuple[Column, Column]:
    """Saturation vapour pressure (kPa) and its slope (kPa/K); over ice below 0."""
    water, ice = 0.61078 * F.exp(17.26939 * t / (t + 237.3)), 0.61078 * F.exp(21.87456 * t / (t + 265.5))
    slope_water, slope_ice = 4098 * water / F.pow(t + 237.3, 2), 5808 * ice / F.pow(t + 265.5, 2)
    return F.when(t < 0, ice).otherwise(water), F.when(t < 0, slope_ice).otherwise(slope_water)


def penman_monteith(aa: Column, vpd: Column, delta: Column, ra: Column, rc: Column) -> Column:
    """Latent heat flux density, W/m2."""
    return (ra * delta * aa + CPRHO * vpd) / ((delta + GAMMA) * ra + GAMMA * rc)


def soil_surface_resistance(psim: Column, psif: Column, rssa: float = RSSA, rssb: float = RSSB) -> Column:
    if rssa < 1e-4:
        return F.lit(1e10)
    return rssa * F.pow(psim / psif, F.lit(rssb))


def snow_fraction(tmax: Column, tmin: Column, rstemp: float = RSTEMP) -> Column:
    part = 1 - F.try_divide(tmax - rstemp, tmax - tmin)
    return F.when(tmin >= rstemp, 0.0).when(tmax < rstemp, 1.0).otherwise(part)


def snow_energy(ta: Column, tsnow: Column, daylen: Column, lai: Column, sai: Column, slfday: Column) -> Column:
    """Energy to the snow pack, MJ/m2 a day: turbulent below 0, degree-day melt above."""
    melt = 2 * MELFAC * daylen * slfday * ta * F.exp(-SAIMLT * sai) * F.exp(-LAIMLT * lai)
    return F.when(ta <= 0, CCFAC * 2 * daylen * (ta - tsnow)).otherwise(melt)


def half_day(lat: Column, dec: Column) -> Column:
    """Half-day length in radians."""
    capped = F.when(F.abs(lat) >= PI / 2, F.signum(lat) * (PI / 2 - 0.01)).otherwise(lat)
    a = -F.tan(dec) * F.tan(capped)
    return F.when(a >= 1, 0.0).when(a <= -1, PI).otherwise(safe_acos(a))


def daily_sine(dec: Column, l2: Column, l1: Column, t3: Column, t2: Column) -> Column:
    """Daily integral of the sine of solar height on a slope."""
    return (F.sin(dec) * F.sin(l1) * (t3 - t2) + F.cos(dec) * F.cos(l1) * (F.sin(t3 + l2) - F.sin(t2 + l2))) / (2 * 3.14159)


def equivalent_slope(lat: Column, slope: Column, aspect: Column) -> tuple[Column, Column]:
    """Latitude of the equivalent horizontal surface and the time shift."""
    l1 = safe_asin(F.cos(slope) * F.sin(lat) + F.sin(slope) * F.cos(lat) * F.cos(aspect))
    d1 = F.cos(slope) * F.cos(lat) - F.sin(slope) * F.sin(lat) * F.cos(aspect)
    d1 = F.when(d1 == 0, 1e-10).otherwise(d1)
    l2 = F.atan(F.sin(slope) * F.sin(aspect) / d1)
    return l1, F.when(d1 < 0, l2 + PI).otherwise(l2)


def declination(doy: Column) -> Column:
    return safe_asin(0.39785 * F.sin(4.868961 + 0.017203 * doy + 0.033446 * F.sin(6.224111 + 0.017202 * doy)))


def flat_sun(lat: Column, doy: Column) -> tuple[Column, Column]:
    """Day length (fraction of a day) and potential insolation (MJ/m2) of a horizontal surface."""
    scd = SOLAR / F.pow(1 - 0.0167 * F.cos(0.0172 * (doy - 3)), 2)
    dec = declination(doy)
    half = half_day(lat, dec)
    i0h = WTOMJ * scd * daily_sine(dec, F.lit(0.0), lat, half, -half)
    return clamp(half / PI, 0.0001, 0.9999), i0h


def slope_factor(lat: Column, doy: Column, slope: Column, aspect: Column) -> Column:
    """Ratio of potential insolation on the slope to that on the horizontal.

    A steep slope's day, shifted in time, can meet the horizontal day twice: both parts count.
    """
    dec, (_, i0h) = declination(doy), flat_sun(lat, doy)
    l1, l2 = equivalent_slope(lat, slope, aspect)
    # the angles of a row are worked out once and bound as one value, which keeps the generated code small
    angles = F.struct(dec.alias("dec"), l1.alias("l1"), l2.alias("l2"), half_day(lat, dec).alias("half"), i0h.alias("i0h"))

    def own_day(x: Column) -> Column:
        return x.withField("own", half_day(x["l1"], x["dec"]))

    def insolation(x: Column) -> Column:
        scd = SOLAR / F.pow(1 - 0.0167 * F.cos(0.0172 * (doy - 3)), 2)

        def part(turn: Column) -> Column:
            t3, t2 = F.least(x["half"], x["own"] - x["l2"] + turn), F.greatest(-x["half"], -x["own"] - x["l2"] + turn)
            return F.when(t3 > t2, daily_sine(x["dec"], x["l2"], x["l1"], t3, t2)).otherwise(0.0)

        turns = F.transform(F.array(F.lit(-2 * PI), F.lit(0.0), F.lit(2 * PI)), part)
        total = WTOMJ * scd * F.aggregate(turns, F.lit(0.0), lambda acc, v: acc + v) / F.cos(slope)
        return F.when(x["i0h"] <= 0, 0.0).otherwise(F.try_divide(total, x["i0h"]))

    return F.element_at(F.transform(F.transform(F.array(angles), own_day), insolation), 1)


def day_night(solrad: Column, i0h: Column, tmax: Column, tmin: Column, ea: Column, uw: Column, daylen: Column, wndadj: Column) -> dict[str, Column]:
    """Corrected radiation, day and night temperatures, vapour pressure and winds."""
    ta = (tmax + tmin) / 2
    sine = F.sin(PI * daylen)
    day = ta + ((tmax - tmin) / (2 * PI * daylen)) * sine
    night = ta - ((tmax - tmin) / (2 * PI * (1 - daylen))) * sine
    wind = F.greatest(F.lit(0.2), F.when(uw == 0, 0.1).otherwise(uw))
    ua = wind * wndadj
    uday = ua / (daylen + (1 - daylen) * WNDRAT)
    return {
        "solradc": F.when(solrad < 0.001, RRD * i0h).when(solrad > i0h, 0.99 * i0h).otherwise(solrad),
        "ta": ta, "tadtm": day, "tantm": night, "ea": F.when(ea == 0, esat(tmin)[0]).otherwise(ea),
        "ua": ua, "uadtm": uday, "uantm": WNDRAT * uday,
    }


def wind_adjustment(za: Column, disp: Column, z0: Column, fetch: float = FETCH, zw: float = ZW, z0w: float = Z0W) -> Column:
    hibl = 0.334 * fetch**0.875 * z0w**0.125
    return F.log(hibl / F.lit(z0w)) * F.log((za - disp) / z0) / (F.log(hibl / z0) * F.log(F.lit(zw / z0w)))


def available_energy(slrad: Column, albedo: Column, ea: Column, ta: Column, ratio: Column, shf: Column, cr: Column, lai: Column, sai: Column) -> tuple[Column, Column]:
    """Available energy of the whole surface and of the ground, W/m2."""
    solar = (1 - albedo) * slrad
    effem = 1.24 * F.pow(ea * 10 / (ta + 273.15), 1 / F.lit(7.0))
    clouds = C3 + (1 - C3) * clamp((ratio - C1) / C2, 0.0, 1.0)
    net = solar + (effem - 1) * clouds * SIGMA * F.pow(ta + 273.15, 4)
    return net - shf, net * F.exp(-cr * (lai + sai)) - shf


def roughness(height: Column, lai: Column, sai: Column, z0g: Column) -> dict[str, Column]:
    """Roughness lengths, displacements and the reference height, m."""
    z0c = F.when(height >= HR, CZR * height).when(height <= HS, CZS * height).otherwise(CZS * HS + (CZR * HR - CZS * HS) * (height - HS) / (HR - HS))
    dispc = height - z0c / 0.3
    z0gs = F.least(z0g, z0c)
    ratio = (lai + sai) / (LPC + CS * height)
    xx = ratio * F.pow(-1 + F.exp(0.909 - 3.03 * z0c / height), 4)
    disp = F.when(ratio >= 1, dispc).otherwise(1.1 * height * F.log(1 + F.pow(xx, 0.25)))
    z0 = F.when(ratio >= 1, z0c).otherwise(F.least(0.3 * (height - disp), z0gs + 0.3 * height * F.sqrt(xx)))
    return {"z0gs": z0gs, "z0c": z0c, "dispc": dispc, "z0": z0, "disp": disp, "za": height + ZMINH}


def canopy_resistance(rad: Column, ta: Column, vpd: Column, lai: Column, sai: Column, glmin: float, glmax: Column, cr: Column) -> Column:
    """Canopy surface resistance, s/m, from light, humidity and temperature."""
    fs = (2 * lai + sai) / (2 * lai)
    r0 = RM * R5 / (RM - 2 * R5)
    light = ((RM + r0) / (RM * cr * fs)) * F.log((r0 + cr * rad) / (r0 + cr * rad * F.exp(-cr * fs * lai)))
    warm = (
        F.when(ta <= TL, 0.0).when((ta > TL) & (ta < T1), 1 - F.pow((T1 - ta) / (T1 - TL), 2)).when((ta >= T1) & (ta <= T2), 1.0)
        .when((ta > T2) & (ta < TH), 1 - F.pow((ta - T2) / ((TH - T2) or 1.0), 2)).otherwise(0.0)
    )
    fd = 1 / (1 + vpd / CVPD)
    return 1 / (fd * warm * F.when(rad <= 1e-10, 0.0).otherwise(light) * (glmax - glmin) + lai * glmin)


def aerodynamics(ua: Column, za: Column, height: Column, z0: Column, disp: Column, z0c: Column, dispc: Column, z0gs: Column, lwidth: Column, lai: Column, sai: Column) -> dict[str, Column]:
    """Shuttleworth-Wallace-Gurney resistances raa, rac, ras, s/m."""
    ustar = KARMAN * ua / F.log((za - disp) / z0)
    kh = KARMAN * ustar * (height - disp)
    ras = (height * F.exp(F.lit(NN)) / (NN * kh)) * (F.exp(-NN * z0gs / height) - F.exp(-NN * (z0c + dispc) / height))
    raa = F.log((za - disp) / (height - disp)) / (KARMAN * ustar) + (height / (NN * kh)) * (-1 + F.exp(NN * (height - dispc - z0c) / height))
    uh = (ustar / KARMAN) * F.log((height - disp) / z0)
    rb = (100 * NN) * F.sqrt(lwidth / uh) / (1 - F.exp(F.lit(-NN / 2)))
    return {"raa": raa, "rac": rb / (RHOTP * lai + PI * sai), "ras": F.greatest(F.lit(1.0), ras)}


def potential_rates(aa: Column, asubs: Column, vpd: Column, raa: Column, rac: Column, ras: Column, rsc: Column, rss: Column, delta: Column) -> tuple[Column, Column]:
    """Shuttleworth-Wallace potential transpiration and ground evaporation, mm a day."""
    rs, rc, ra = (delta + GAMMA) * ras + GAMMA * rss, (delta + GAMMA) * rac + GAMMA * rsc, (delta + GAMMA) * raa
    ccs, ccc = 1 / (1 + rs * ra / (rc * (rs + ra))), 1 / (1 + rc * ra / (rs * (rc + ra)))
    pms = penman_monteith(aa, vpd - delta * ras * (aa - asubs) / CPRHO, delta, raa + ras, rss)
    pmc = penman_monteith(aa, vpd - delta * rac * asubs / CPRHO, delta, raa + rac, rsc)
    le = ccc * pmc + ccs * pms
    d0 = vpd + raa * (delta * aa - (delta + GAMMA) * le) / CPRHO
    return ETOM * WTOMJ * penman_monteith(aa - asubs, d0, delta, rac, rsc), ETOM * WTOMJ * penman_monteith(asubs, d0, delta, ras, rss)


def ground_evaporation(aa: Column, asubs: Column, vpd: Column, raa: Column, ras: Column, rss: Column, delta: Column, arate: Column) -> Column:
    """Ground evaporation where transpiration is limited to ``arate``, mm a day."""
    lec = arate / (ETOM * WTOMJ)
    rs, ra = (delta + GAMMA) * ras + GAMMA * rss, (delta + GAMMA) * raa
    le = (rs / (rs + ra)) * lec + (CPRHO * vpd + delta * ras * asubs + delta * raa * aa) / (rs + ra)
    return ETOM * WTOMJ * (le - lec)


def snow_evaporation(tsnow: Column, ta: Column, ea: Column, raa: Column, ras: Column, ksnvp: Column) -> Column:
    at = F.when(tsnow > -0.1, 0.61).otherwise(esat(F.least(ta, tsnow))[0])
    return ksnvp * (WTOMJ / LS) * (CPRHO / GAMMA) * (at - ea) / (raa + ras)


def ground_water(gwat: Column, gsc: float, gsp: float, inflow: Column, dt: float = 1.0) -> tuple[Column, Column]:
    """Ground-water flow and deep seepage, mm a day."""
    if gsc < 1e-8:
        return inflow - gsp * inflow, gsp * inflow
    total = F.least(gwat * gsc, gwat / dt)
    return total * (1 - gsp), total * gsp


def interception(rate: Column, potential: Column, store: Column, lai: Column, sai: Column, fl: float, fs: float, cl: float, cs: float, dt: Column) -> tuple[Column, Column]:
    """Catch rate and evaporation rate of a canopy store over an interval, mm a day."""
    capacity, most = cl * lai + cs * sai, (fl * lai + fs * sai) * rate
    new = store + (most - potential) * dt
    evaporated = F.when(new > 0, potential).otherwise(store / dt + most)
    caught = F.when((new > 0) & (new > capacity), potential + (capacity - store) / dt).otherwise(most)
    return caught, evaporated


def matric_potential(w: Column, psif: Column, bexp: Column, wetinf: Column, wetf: Column, chm: Column, chn: Column) -> Column:
    """Potential (kPa) of a wetness, Clapp-Hornberger with the near-saturation parabola."""
    return F.when(w <= 0, -1e10).when(w < wetinf, psif * F.pow(w / wetf, -bexp)).when(w < 1, chm * (w - chn) * (w - 1)).otherwise(0.0)


def potential_slope(w: Column, psif: Column, bexp: Column, wetinf: Column, wetf: Column, chm: Column, chn: Column) -> Column:
    """Derivative of the potential by wetness."""
    return F.when(w < wetinf, (-bexp * psif / wetf) * F.pow(w / wetf, -bexp - 1)).when(w < 1, chm * (2 * w - chn - 1)).otherwise(0.0)


def soil_constants(psif: Column, thetaf: Column, thsat: Column, bexp: Column, wetinf: Column, kf: Column) -> dict[str, Column]:
    """Constants of a soil layer."""
    wetf = thetaf / thsat
    psiinf = psif * F.pow(wetinf / wetf, -bexp)
    chm = -psiinf / F.pow(1 - wetinf, 2) + bexp * psiinf / (wetinf * (1 - wetinf))
    chn = 2 * wetinf - 1 + psiinf * bexp / (chm * wetinf)
    return {"wetf": wetf, "psiinf": psiinf, "chm": chm, "chn": chn, "ksat": kf * F.pow(1 / wetf, 2 * bexp + 3), "wetc": wetf * F.pow(1000 * F.lit(-2.0) / psif, -1 / bexp)}


def conductivity(w: Column, kf: Column, wetf: Column, bexp: Column) -> Column:
    return F.when(w > 1e-4, kf * F.pow(w / wetf, 2 * bexp + 3)).otherwise(1e-10)


def vertical_flow(k1: Column, k2: Column, ks1: Column, ks2: Column, th1: Column, th2: Column, psi1: Column, psi2: Column, stone1: Column, stone2: Column, least: float = 0.01) -> Column:
    """Flow from one layer to the next, mm a day; none where total potentials hardly differ."""
    kk = F.least(F.sqrt(k1 * k2), ks1, ks2)
    flow = ((psi1 - psi2) / F.least(th1, th2)) * kk / RHOWG * (1 - (stone1 + stone2) / 2)
    return F.when(F.abs(psi1 - psi2) < least, 0.0).otherwise(flow)


def downslope_flow(k: Column, slope: float, length: float, thick: Column, stone: Column, psim: Column) -> Column:
    """Flow out of a layer along the slope, mm a day."""
    if length == 0 or slope < 0.01:
        return F.lit(0.0)
    import math

    grad = RHOWG * math.sin(slope) + (2 * psim / length) * math.cos(slope)
    return F.greatest(F.lit(0.0), k * thick * (1 - stone) * grad / (RHOWG * length * math.cos(slope)))


def at_day(doy: Column, pairs: list[float]) -> Column:
    """Piecewise linear function of the day of year through (day, value) pairs."""
    days, values = pairs[::2], pairs[1::2]
    out = F.lit(float(values[-1]))
    for i in range(len(days) - 2, -1, -1):
        part = values[i] + (doy - days[i]) * ((values[i + 1] - values[i]) / (days[i + 1] - days[i]))
        out = F.when(doy < days[i + 1], part).otherwise(out)
    return F.when(doy <= days[0], float(values[0])).otherwise(out)
