"""The incident table as it is exchanged: 56 columns and their roles."""

from __future__ import annotations

from pyspark.sql import types as T

from ..columns import Columns

# Column names and types of the incident table, in file order.
INCIDENT_DDL = """
Incident_ID string, District string, State string, Year int, Month int, Quarter int, Week int,
Crime_Category string, Sub_Category string, Complaint_Channel string, Population bigint,
Crime_Count_District bigint, Crime_Rate_100k double, Trend_Last_3_Years double, Growth_Rate double,
Historical_Growth double, Expected_Growth double, Risk_Index double, Risk_Percentile double, Risk_Rank int,
Trend_Score double, Nearby_Hotspot_Score double, Anomaly_Score double, Latitude double, Longitude double,
Coordinate_Type string, Urban_Rural string, Financial_Loss double, Victim_Age_Group string, Victim_Gender string,
Time_of_Day string, Day_of_Week string, Is_Weekend boolean, Is_Office_Hour boolean, Is_Night boolean,
Is_Festival_Month boolean, Reporting_Delay double, Resolved boolean, Response_Time double,
Police_Station_ID string, Administrative_Code string, Neighbor_District_Risk double, Spatial_Lag double,
Local_Moran_I_Proxy double, Cluster_ID int, Distance_to_District_HQ_km double,
Distance_to_Nearest_Police_Station_km double, Urban_Density_Proxy double, Commercial_Density_Proxy double,
Digital_Adoption_Tier string, Source_Confidence double, Data_Source string, Aggregate_Basis string,
Sample_Weight double, Official_Unit_Year_Total bigint, Incident_Date date
"""
# End of fixed values.


def incident_schema() -> T.StructType:
    return T.StructType.fromDDL(INCIDENT_DDL)


INCIDENT_COLUMNS = Columns(
    id="Incident_ID", unit="District", state="State", date="Incident_Date", year="Year", month="Month",
    quarter="Quarter", week="Week", target="Crime_Count_District", weight="Sample_Weight", lat="Latitude",
    lon="Longitude", category="Crime_Category", station="Police_Station_ID", population="Population", cell="h3_index",
)
