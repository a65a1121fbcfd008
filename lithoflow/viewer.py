"""The tabs of a viewer over the tables of a build: ``python -m lithoflow.cli app``."""

from __future__ import annotations

from lithoflow import config
from lithoflow.plans import views


def main() -> None:
    import streamlit as st
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    out = config.from_env().out
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    tabs = st.tabs(["Sheets", "Ground", "Units", "Review"])
    with tabs[0]:
        st.dataframe(views.sheet_overview(read("boundaries")).toPandas())
    with tabs[1]:
        types = [r[0] for r in views.ground_types(read("geotech_features")).collect()]
        chosen = st.multiselect("Ground types", types)
        layer = views.ground_layer(read("geotech_features"), chosen or None)
        st.bar_chart(views.type_counts(layer).toPandas().set_index("engineering_ground_type"))
    with tabs[2]:
        labels = {r.label: r.geology_unit_card_id for r in views.unit_labels(read("cards")).collect()}
        unit = st.selectbox("Unit", sorted(labels))
        if unit:
            st.json(views.chain_rows(read("cards").where(f"geology_unit_card_id = '{labels[unit]}'")).toPandas().to_json(orient="records"))
    with tabs[3]:
        st.dataframe(views.review_list(read("flat_cards")).toPandas())


if __name__ == "__main__":
    main()
